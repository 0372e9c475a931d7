"""JSON with comments, notes, tab-separated rows, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import relaxed_json
from ..functions.text import note_text, tsv_cell

#: The fields of a dictionary profile's file.
PROFILE = (
    "schemaVersion int, id string, name string, description string, language string, "
    "entries array<struct<observed:string,output:string,enabled:boolean,hotword:boolean,priority:int,note:string>>, "
    "symbols map<string,string>, hotwords array<string>, hallucinations array<string>"
)
#: The columns of a table of segments in two languages.
BILINGUAL = "n int, start double, end double, dur double, lid string, p_lid double, p_ja double, p_en double, ja_logprob double, ja_latin double, ja_rep double, ja_blocked string, ja_text string, en_logprob double, en_rep double, en_blocked string, en_text string"


def read_json(spark: SparkSession, path: str, schema: str = PROFILE) -> DataFrame:
    """A row for each file: (file, data); data is null where neither strict nor relaxed JSON can be read."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), relaxed_json(F.col("value"), schema).alias("data"))


def profile_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables that operators/dictionary.py works on, of read_json()'s rows."""
    own = files.select("data.*").withColumnRenamed("id", "profile")
    words = [own.select("profile", F.lit(k).alias("kind"), F.posexplode(c).alias("ord", "word")) for k, c in (("hotword", "hotwords"), ("hallucination", "hallucinations"))]
    return {
        "profiles": own.select("profile", F.col("schemaVersion").alias("schema_version"), "name", "description"),
        "entries": own.select("profile", F.posexplode("entries").alias("ord", "e")).select("profile", "ord", "e.*"),
        "symbols": own.select("profile", F.posexplode(F.map_entries("symbols")).alias("ord", "e")).select("profile", "ord", F.col("e.key").alias("symbol"), F.col("e.value").alias("output")),
        "words": words[0].union(words[1]),
    }


def signature(spark: SparkSession, *patterns: str) -> list[tuple[str, object, int]]:
    """(path, time of the last change, size) of each file, by path; contents aren't read."""
    found = spark.read.format("binaryFile").load(list(patterns)).select("path", "modificationTime", "length")
    return sorted(tuple(r) for r in found.collect())


class Reloading:
    """What load() gives of some files: read again once their signature changes. If that fails, what was read before (at first: default) stays, and error says why."""

    def __init__(self, spark: SparkSession, patterns: tuple[str, ...], load: Callable[[], object], default: object = None):
        self.spark, self.patterns, self.load = spark, patterns, load
        self.value, self.error, self.seen = default, None, None

    def get(self) -> object:
        try:
            now = signature(self.spark, *self.patterns)
        except Exception as e:  # whatever the file system says: the last good state stays
            now, self.error = None, f"{type(e).__name__}: {e}"
        if now is not None and now != self.seen:
            try:
                self.value, self.error = self.load(), None
            except Exception as e:
                self.error = f"{type(e).__name__}: {e}"
            self.seen = now
        return self.value


def write_json(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON rows. Spark's committer shows either all new files or none."""
    df.write.mode("overwrite").json(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), note_text(F.col("value")).alias("text"))


def tsv_rows(df: DataFrame) -> DataFrame:
    """Every column as its cell."""
    return df.select(*[tsv_cell(F.col(name), kind).alias(name) for name, kind in df.dtypes])


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_rows(df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str = BILINGUAL) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def reused(make, spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; made and written first if it isn't there. The path names the parameters."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        make().write.parquet(path)
    return spark.read.parquet(path)


def report_lines(kinds: DataFrame, hunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(part, ord, line): a Markdown report of aggregates and bounded lists."""
    a = kinds.select(F.lit(0).alias("part"), F.col("kind").alias("ord"), F.format_string("- %s: %d", "kind", "n").alias("line"))
    b = hunks.select(F.lit(1).alias("part"), F.col("at").cast("string").alias("ord"), F.format_string("- `%s` %s …%s【%s】%s…", "at", "kind", "live_left", "live", "live_right").alias("line"))
    c = terms.select(F.lit(2).alias("part"), F.format_string("%09d", -F.col("n") + 999_999_999).alias("ord"), F.format_string("- %s × %d", "term", "n").alias("line"))
    return a.union(b).union(c).orderBy("part", "ord", "line")
