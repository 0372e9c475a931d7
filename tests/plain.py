"""Plain versions of the queries that have no SQL: what they give over the small tables, as sorted rows."""

import difflib
import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict
from itertools import accumulate

import pyarrow.parquet as pq
from test_morphemes import inline, marked
from test_segments import loop

from cadenza.functions.text import UNCOMPARED, UNCOMPARED_BY_CLIENT
from cadenza.operators.reconvert import VOICING
from cadenza.params import FRAME, RATE, Segmenting
from cadenza.queries.composed import UNITS, unit


def _read(tables, name, *columns):
    return list(zip(*pq.read_table(f"{tables}/{name}.parquet", columns=list(columns)).to_pydict().values(), strict=True))


def _norm(text):
    """The comparable characters with their places."""
    out = []
    for i, c in enumerate(text or ""):
        for x in unicodedata.normalize("NFKC", c):
            if not x.isspace() and x not in UNCOMPARED:
                out += [(y, i) for y in x.lower()]
    return "".join(x for x, _ in out), [i for _, i in out]


def compressed_repetition(tables):
    return [(d, len(zlib.compress(raw, 6)) / len(raw) if len(raw := (t or "").encode()) >= 24 else 1.0) for d, t in _read(tables, "documents", "doc_id", "text")]


def adjacent_repeats(tables):
    out = []
    for d, t in _read(tables, "documents", "doc_id", "text"):
        s, at = _norm(t)
        i = 0
        while i < len(s):
            n = next((n for n in range(min(40, (len(s) - i) // 2), 3, -1) if s[i : i + n] == s[i + n : i + 2 * n]), 0)
            if n:
                out.append((d, at[i], s[i : i + n]))
            i += 2 * n or 1
    return out


def _versions(tables):
    for c, k, t in _read(tables, "conversations", "conv_id", "turn", "text"):
        yield c, k, t, t.replace("the ", "").replace("ing", "ign")


def text_differences(tables):
    """The alignment as a string, a letter a step: = for a character of both, x for one of either; differences are what a pattern finds in it."""
    out = []
    for c, k, ref, live in _versions(tables):
        (a, at), (b, bt) = _norm(live), _norm(ref)
        steps, upto = [], (0, 0)
        for block in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            steps += [("x", 1, 0)] * (block.a - upto[0]) + [("x", 0, 1)] * (block.b - upto[1]) + [("=", 1, 1)] * block.size
            upto = block.a + block.size, block.b + block.size
        place_a, place_b = ([0, *accumulate(s[n] for s in steps)] for n in (1, 2))
        text = lambda t, own, span: t[own[span][0] : own[span][-1] + 1] if own[span] else ""
        for m in re.finditer("x(?:x|={1,8}(?=x))*", "".join(s[0] for s in steps)):
            x, y = (slice(p[m.start()], p[m.end()]) for p in (place_a, place_b))
            mine, theirs = text(live, at, x).strip(), text(ref, bt, y).strip()
            around = [text(t, own, s).replace("\n", " ") for t, own, z in ((live, at, x), (ref, bt, y)) for s in (slice(max(0, z.start - 24), z.start), slice(z.stop, z.stop + 24))]
            if mine and theirs or len(mine + theirs) > 1:
                out.append((c, k, {(True, True): "相違", (True, False): "余分"}.get((mine > "", theirs > ""), "脱落"), mine, theirs, (bt[y.start :] or bt[-1:] or [0])[0], *around))
    return out


def text_match_ratio(tables):
    return [(c, k, difflib.SequenceMatcher(None, _norm(live)[0], _norm(ref)[0], autojunk=False).ratio()) for c, k, ref, live in _versions(tables)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def word_errors(tables):
    words = lambda t: "".join(c if c.isalnum() or c in "_'" or c.isspace() else " " for c in t.lower()).split()
    return [(c, k, _distance(words(ref), words(live)) / len(words(ref)) if words(ref) else 0.0) for c, k, ref, live in _versions(tables)]


def safe_refinements(tables):
    def shared(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(left[j - 1] + 1 if x == y else max(left[j], row[-1]))
        return row[-1] / len(a) if a else 1.0

    out = []
    for c, k, ref, live in _versions(tables):
        x, y = (re.sub(UNCOMPARED_BY_CLIENT, "", unicodedata.normalize("NFKC", t)) for t in (ref, live))
        edge = max(16, min(48, len(x) // 4))
        why = None
        if x and len(y) < 0.78 * len(x):
            why = "too-short"
        elif len(x) >= 24:
            why = "leading-content-lost" if shared(x[:edge], y[: 2 * edge]) < 0.4 else "trailing-content-lost" if shared(x[-edge:], y[-2 * edge :]) < 0.4 else "content-diverged" if shared(x, y) < 0.45 else None
        out.append((c, k, why is None, why))
    return out


def _sessions(tables):
    """Levels of each session in their order."""
    own = defaultdict(list)
    for v, e in sorted(_read(tables, "embeddings", "vec_id", "embedding")):
        own[v // 16] += [(v % 16 * 64 + i, round(abs(float(x)) / 8, 6)) for i, x in enumerate(e)]
    return {s: [x for _, x in sorted(rows)] for s, rows in own.items()}


def _segments(levels, shortest):
    return loop(levels, Segmenting(silence=0.16, longest=3.0, shortest=shortest, pad=0.06))


def forced_cut(tables):
    return [(str(s), *own) for s, levels in _sessions(tables).items() for own in _segments(levels, 0.3)]


def _joined(arrivals):
    """(now, segment or None for a look at the clock) in their order, joined up to 4 seconds, held for 6, parted at pauses of 2."""
    held, since, out = None, 0.0, []
    for now, own in arrivals:
        if held and now - since >= 6.0:
            out.append(held)
            held = None
        if own is None:
            continue
        begun = now
        if held:
            if held[1] == own[0] and (own[3] is None or own[3] < 2.0):
                own, begun = (held[0], own[1], own[2], held[3]), since
            else:
                out.append(held)
            held = None
        if own[1] - own[0] >= 4 * RATE:
            out.append(own)
        else:
            held, since = own, begun
    return [*out, held] if held else out


def joined_chunks(tables):
    return [(str(s), *own[:3]) for s, levels in _sessions(tables).items() for own in _joined([(x[1] / RATE, x) for x in _segments(levels, 0.3)])]


def replayed_chunks(tables):
    """A block of a tenth of a second at a time: what closes with its frames comes at its end, then the clock is looked at."""
    out = []
    for s, levels in _sessions(tables).items():
        whole, closed, arrivals = _segments(levels, 0.1), 0, []
        size = len(levels) * FRAME
        for i in range(0, size, 1600):
            now, have = (i + 1600) / RATE, min(i + 1600, size) // FRAME
            # closed so far: what further silence, and further sound, leave as it is
            quiet, loud = (_segments(levels[:have] + more, 0.1) for more in ([0.0] * 400, [0.9] * 400))
            n = 0
            while n < len(whole) and n < len(quiet) and n < len(loud) and whole[n] == quiet[n] == loud[n]:
                n += 1
            arrivals += [(now, x) for x in whole[closed:n]] + [(now, None)]
            closed = max(closed, n)
        arrivals += [(size / RATE, x) for x in whole[closed:]]
        out += [(str(s), *own[:3]) for own in _joined(arrivals)]
    return out


def reading_variants(tables):
    bad = lambda r: not r or r[0] in "んっー" or r[-1] == "っ" or any(a in "っん" and b in "っん" for a, b in zip(r, r[1:], strict=False)) or any(a == "っ" and b not in "かきくけこさしすせそたちつてとぱぴぷぺぽ" for a, b in zip(r, r[1:], strict=False))
    out = []
    for r in ("ては", "へんかん", "かこ", "へんか"):
        voicing = [r[:i] + o + r[i + 1 :] for i, c in enumerate(r) for g in VOICING if c in g for o in g if o != c]
        hatsuon = [r[:i] + r[i + 1 :] for i, c in enumerate(r) if c == "ん"] + [r + "ん"] + [r[:i] + "ん" + r[i:] for i in range(1, len(r))]
        sokuon = [r[:i] + r[i + 1 :] for i, c in enumerate(r) if c in "っー"] + [r[:i] + "っ" + r[i:] for i in range(1, len(r))]
        seen, lists = {r}, []
        for kind, own in (("voicing", voicing), ("hatsuon", hatsuon), ("sokuon", sokuon)):
            lists.append([(v, kind) for v in own if not bad(v) and v not in seen and not seen.add(v)])
        turns = [x for k in range(max(map(len, lists))) for own in lists for x in own[k : k + 1]]
        out += [(r, v, kind, n) for n, (v, kind) in enumerate(turns[:6], 1)]
    return out


def _morphemes(tables):
    for (i,) in _read(tables, "events", "event_id"):
        yield i, [(s, r, (pos.split(" ") + ["-"] * 6)[:6]) for s, r, pos in (UNITS[int(unit(i, k))] for k in range(6))]


def symbols_within(tables):
    return [(i, inline(own)) for i, own in _morphemes(tables)]


def punctuated_texts(tables):
    return [(i, marked(own)) for i, own in _morphemes(tables)]


def replace_dictionary(tables):
    keys = {w for (t,) in _read(tables, "conversations", "text") for w in re.findall("[a-z]{4,}", (t or "").lower())}
    by_length = sorted({len(k) for k in keys}, reverse=True)
    out = []
    for d, t in _read(tables, "documents", "doc_id", "text"):
        parts, i = [], 0
        while i < len(t):
            n = next((n for n in by_length if t[i : i + n] in keys and len(t) >= i + n), 0)
            parts.append(f"<{t[i : i + n].upper()}>" if n else t[i])
            i += n or 1
        out.append((d, hashlib.md5("".join(parts).encode()).hexdigest()))
    return out


PLAIN = {f.__name__: f for f in (compressed_repetition, adjacent_repeats, text_differences, text_match_ratio, word_errors, safe_refinements, forced_cut, joined_chunks, replayed_chunks, reading_variants, symbols_within, punctuated_texts, replace_dictionary)}
