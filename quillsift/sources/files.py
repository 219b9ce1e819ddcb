"""Sources and sinks: message folders, models, event logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators.model import TOKENS_DDL, TOTALS_DDL
from quillsift.shared import group_index

MSGID_BYTES, SCORE_BYTES = 16_384, 8_192
MESSAGE_DDL = "path string, modificationTime timestamp, length bigint, content binary"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern names anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Raw messages of a folder (not of those below it); an absent folder is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], MESSAGE_DDL)
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """Messages of all ``cur`` folders below ``root`` with their ``folder``: INBOX or ``.Name``; trash is left out."""
    # folders are named by pattern: below a given path, names with a leading dot would be passed over
    found = [p for p in (f"{root}/cur", f"{root}/.*/cur") if matches(spark, p)]
    if not found:
        return spark.createDataFrame([], MESSAGE_DDL).withColumn("folder", F.lit(None).cast("string"))
    df = spark.read.format("binaryFile").load(found)
    sub = F.regexp_extract("path", r"/(\.[^/]+)/cur/[^/]*$", 1)
    folder = F.when(sub != "", sub).otherwise("INBOX")
    return df.withColumn("folder", folder).filter(F.lower("folder") != ".trash")


def read_since(spark: SparkSession, path: str, cursor) -> DataFrame:
    """Messages changed after a cursor. The reader skips older files by their time."""
    return read_folder(spark, path, recursive=True).filter(F.col("modificationTime") > F.lit(cursor).cast("timestamp"))


def stream_folder(spark: SparkSession, path: str) -> DataFrame:
    """New messages of a folder as a stream; its checkpoint is the cursor."""
    return spark.readStream.format("binaryFile").schema(MESSAGE_DDL).option("recursiveFileLookup", "true").load(path)


def _head(content: Column, n: int) -> Column:
    return F.make_valid_utf8(F.substring(content, 1, n).cast("string"))


def sniff_msgid(content: Column) -> Column:
    """The Message-Id of the header block within the first bytes; folded lines are joined. NULL without one."""
    head = F.substring(content, 1, MSGID_BYTES)
    text = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string"))
    header = F.regexp_extract(F.concat(F.lit("\n"), F.regexp_replace(text, "\r", "")), r"(?s)^(.*?)(?:\n\n|$)", 1)
    found = F.regexp_extract(F.regexp_replace(header, r"\n[ \t]+", " "), r"(?im)^message-id:([^\n]*)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def sniff_msgid_anywhere(content: Column) -> Column:
    """The first ``message-id:`` line anywhere in a message, its backslashes and quotes escaped, cut to 200 bytes."""
    text = F.make_valid_utf8(content.cast("string"))
    found = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?im)^message-id:[ \t]*([^\n]*)", 1), "\r", ""))
    escaped = F.regexp_replace(found, r'([\\"])', r"\\$1")
    return F.nullif(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(escaped, "UTF-8"), 1, 200).cast("string")), "\ufffd$", ""), F.lit(""))


def sniff_verdict(content: Column) -> Column:
    """``verdict`` and ``score`` of the status header within the first bytes."""
    head, pattern = _head(content, SCORE_BYTES), r"(?im)^X-Spam-Status: (SPAM|GOOD) ([0-9.]+)"
    v = F.upper(F.regexp_extract(head, pattern, 1))
    return F.when(v != "", F.struct(v.alias("verdict"), F.regexp_extract(head, pattern, 2).try_cast("double").alias("score")))


def message_owner(path: Column) -> Column:
    """``user@domain`` of a path ``.../domain/msg/user``."""
    parts = F.split(F.lower(path), "/")
    return F.concat(F.try_element_at(parts, F.lit(-1)), F.lit("@"), F.try_element_at(parts, F.lit(-3)))


class ModelStore:
    """A model as two Parquet tables under a path, in versions.

    A version is written beside the current one and then named in ``current``: readers keep what they opened.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def version(self) -> int | None:
        if not exists(self.spark, f"{self.path}/current"):
            return None
        return self.spark.read.schema("version int").json(f"{self.path}/current").first()[0]

    def open(self) -> tuple[DataFrame, DataFrame]:
        """Tokens and totals; of a model that is not there yet, empty tables."""
        v = self.version
        if v is None:
            return self.spark.createDataFrame([], TOKENS_DDL), self.spark.createDataFrame([], TOTALS_DDL)
        return self.spark.read.schema(TOKENS_DDL).parquet(f"{self.path}/v{v}/tokens"), self.spark.read.schema(TOTALS_DDL).parquet(f"{self.path}/v{v}/totals")

    def open_existing(self) -> tuple[DataFrame, DataFrame]:
        """Like :meth:`open`, but a missing model is an error and nothing is created."""
        if self.version is None:
            raise FileNotFoundError(self.path)
        return self.open()

    def save(self, tokens: DataFrame, totals: DataFrame) -> int:
        v = (self.version or 0) + 1
        tokens.write.mode("overwrite").parquet(f"{self.path}/v{v}/tokens")
        totals.write.mode("overwrite").parquet(f"{self.path}/v{v}/totals")
        self.spark.range(1).select(F.lit(v).cast("int").alias("version")).coalesce(1).write.mode("overwrite").json(f"{self.path}/current")
        return v


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, line_no, line`` of text files; line numbers count within a file.

    Lines are numbered over a file's splits in byte order, without gathering a file.
    """
    df = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return group_index(df, ["file"], ["start", "at"]).select("file", (F.col("__i") + 1).alias("line_no"), "line")


TRAIN_JSON = "type string, t string, u string, v string, sess string"
DELIVERY_JSON = "type string, t string, u string, verdict string, score double, folder string, msgid string, sess string"
SHADOW_JSON = "t string, v string, cmd string, user string, msgid string, primary string, cand string"
STATS_JSON = "d string, db array<bigint>, `in` array<bigint>, jk array<bigint>, corr struct<fn:bigint,fp:bigint>, w array<string>"


def read_json_lines(lines: DataFrame, ddl: str, column: str = "line") -> DataFrame:
    """Records of JSON lines under a fixed schema, with ``bad``: lines that are none."""
    spec = f"{ddl}, __corrupt string"
    r = F.from_json(F.trim(F.col(column)), spec, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    d = lines.filter(F.trim(F.col(column)) != "").withColumn("r", r)
    return d.select("*", "r.*").withColumn("bad", F.col("__corrupt").isNotNull()).drop("r", "__corrupt")


def load_deliveries(lines: DataFrame, user: str | None = None) -> DataFrame:
    """``u, msgid, verdict, score, folder, seq`` of delivery lines (``line, line_no``), of one owner or all: the last line of
    a message counts. Left out are lines of another type and those without owner, msgid, verdict or folder."""
    d = read_json_lines(lines, DELIVERY_JSON).filter("type = 'delivery' and u is not null and msgid is not null and verdict is not null and folder is not null")
    d = d if user is None else d.filter(F.col("u") == user)
    last = d.groupBy("u", "msgid").agg(F.max_by(F.struct("verdict", "score", "folder", F.col("line_no").alias("seq")), "line_no").alias("d"))
    return last.select("u", "msgid", "d.*")


def read_stats_tree(spark: SparkSession, root: str) -> DataFrame:
    """The last readable line of every ``.../domain/msg/user/*stats.jsonl`` below a root, with ``u`` from its path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*stats.jsonl").text(root)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line"))
    good = read_json_lines(lines, STATS_JSON).filter("not bad")
    parts = F.split("file", "/")
    owner = F.lower(F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("@"), F.try_element_at(parts, F.lit(-4))))
    cols = ["d", "db", "in", "jk", "corr", "w"]
    last = good.groupBy("file").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in cols)), "at").alias("r"))
    return last.select(owner.alias("u"), "r.*")


def first_look_back(spark: SparkSession, path: str, cursor=None, now=None) -> DataFrame:
    """Messages changed since a cursor, or in the last 24 hours where there is none; files of one name, time and length in
    several folders (links of one message) come once."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    since = now - F.expr("INTERVAL 24 HOURS") if cursor is None else F.lit(cursor).cast("timestamp")
    df = read_folder(spark, path, recursive=True).filter(F.col("modificationTime") > since)
    return df.withColumn("name", F.substring_index("path", "/", -1)).dropDuplicates(["name", "modificationTime", "length"]).drop("name")


def event_json(deliveries: DataFrame) -> DataFrame:
    """Delivery events as JSON lines: a numeric score as a number, absent fields left out."""
    num = F.col("score").try_cast("double")
    rest = [F.lit("delivery").alias("type"), F.col("t"), F.col("u"), F.col("verdict")]
    tail = [F.col("folder"), F.col("msgid"), F.col("sess")]
    line = F.when(num.isNotNull(), F.to_json(F.struct(*rest, num.alias("score"), *tail))).otherwise(F.to_json(F.struct(*rest, F.col("score"), *tail)))
    return deliveries.select(line.alias("line"))


def train_json(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'T'").select(F.to_json(F.struct(F.lit("train").alias("type"), "t", "u", "v", "sess")).alias("line"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A column ``line`` as text, one file per partition."""
    df.select("line").write.mode(mode).text(path)
