"""Token counts and packing against the tokenizers library."""

import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cadenza.llm import packing, token_counts
from cadenza.llm.shared import scratch
from cadenza.llm.tokenizer import Encoder, encoder, load
from samples import by_id, corpus, frame
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(PATH))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys_over_all_code_points(library):
    enc = Encoder(load(PATH)[0])
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 500):
        own = points[i : i + 500]
        for text in ("".join(own), " ".join(own), "a" + "  b1".join(own)):
            assert enc.ids(text) == ids(library, text)


def test_special_strings_and_runs_of_blanks_are_the_librarys(library):
    enc = Encoder(load(PATH)[0])
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    for text in ["", " ", "\n" * 3000, " " * 6000 + "x", "don't we'll I'M", *(f"a {s} b{s}{s}" for s in special), "a" * 5000, "1234567890" * 50]:
        assert enc.ids(text) == ids(library, text)


def test_counts(spark, library):
    rows = corpus() + corpus()[:5] + [(None, "no id"), (None, None)]
    got = token_counts.token_counts(frame(spark, rows, extra=True), PATH, scratch(spark, "cache"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=key) == sorted(((d, len((t or "").encode()), len(ids(library, t))) for d, t in rows), key=key)


def test_a_second_run_encodes_only_what_the_cache_lacks(spark, library):
    cache = scratch(spark, "cache")
    first = frame(spark, [(1, "one text"), (2, "one text"), (3, None)])
    token_counts.token_counts(first, PATH, cache).collect()
    kept = spark.read.parquet(cache)
    assert kept.count() == 2
    second = frame(spark, [(4, "one text"), (5, "another"), (6, "")])
    got = token_counts.token_counts(second, PATH, cache)
    assert by_id(got, "n_tokens") == [(4, 2), (5, len(ids(library, "another"))), (6, 0)]
    assert spark.read.parquet(cache).count() == 3
    assert token_counts.token_counts(frame(spark, []), PATH, scratch(spark, "cache")).count() == 0


def test_texts_with_one_normal_form_share_an_entry(spark, tmp_path):
    """A tokenizer with a normaliser: counts are the library's, and the cache has an entry for each normal form."""
    own = json.loads(Path(PATH).read_text())
    own["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}
    file = tmp_path / "lower.json"
    file.write_text(json.dumps(own))
    lower = Tokenizer.from_file(str(file))
    special = next(iter(lower.get_added_tokens_decoder().values())).content
    rows = [(1, "One TEXT"), (2, "one text"), (3, "caf\u00e9"), (4, "CAFE\u0301"), (5, f"One {special}"), (6, f"one {special}"), (7, None)]
    cache = scratch(spark, "cache")
    assert by_id(token_counts.token_counts(frame(spark, rows), str(file), cache), "n_tokens") == [(d, len(ids(lower, t))) for d, t in rows]
    assert spark.read.parquet(cache).count() == 5


def test_a_hot_text_is_dealt_over_partitions(spark, library):
    rows = [(i, "the same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(100)]
    got = by_id(token_counts.token_counts(frame(spark, rows), PATH, scratch(spark, "cache")), "n_tokens")
    assert got == sorted((d, len(ids(library, t))) for d, t in rows)


def test_sentencepiece_models_give_their_own_ids():
    for path in Path("/opt/tokenizers").rglob("*.model"):
        data, version = load(str(path))
        own = sentencepiece.SentencePieceProcessor(model_file=str(path))
        for text in ("", "Hello there, world!", "naïve 東京都\n\ttabs", " a  b "):
            assert encoder(data, version).ids(text) == own.encode(text)


@pytest.mark.parametrize("length", [2048, 7])
def test_pieces_hold_each_id_once_and_sequences_have_no_gaps(spark, library, length):
    rows = [r for r in corpus() if r[0] != 90 or length > 100] + [(200, "again"), (200, "again")]
    docs = frame(spark, rows, extra=True)
    pieces = packing.pack(docs, PATH, length, 1)
    got = pieces.collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*ids(library, t), 1], "<u4"))
    place = defaultdict(list)
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        assert any(r.doc_tokens == len(w) and (w[r.start : r.start + r.length] == own).all() for w in want[r.doc_id])
        place[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(w) for v in want.values() for w in v)
    for d, v in want.items():
        assert sum(r.length for r in got if r.doc_id == d) == sum(map(len, v))
    sizes = {}
    for s, own in place.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length for s, n in sizes.items() if s < len(sizes) - 1) and sizes[len(sizes) - 1] <= length


def test_sequences_hold_their_pieces_in_order(spark):
    pieces = packing.pack(frame(spark, corpus()[:20]), PATH, 64, 1)
    for r in packing.sequences(pieces).collect():
        assert sum(b.length for b in r.boundaries) * 4 == len(r.ids)
        assert [b.offset for b in r.boundaries] == sorted(b.offset for b in r.boundaries)
    assert packing.pack(frame(spark, []), PATH, 64, 1).count() == 0
