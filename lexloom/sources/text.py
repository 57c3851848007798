"""Text sources as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file and a stable number within it."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    return raw.select("file", (F.col("k") + 1).alias("line_no"), "line")


def requests(numbered: DataFrame, separator: Column, keys: tuple[str, ...] = ("doc_id",), order: str = "k") -> DataFrame:
    """Lines with the number of their request: separators close one and are dropped."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return numbered.withColumn("request", F.sum(F.when(separator, 1).otherwise(0)).over(w)).filter(~separator)


def named_paragraphs(raw: DataFrame, line: str = "line") -> DataFrame:
    """``name TAB text`` or ``name | id TAB text``; any other number of fields fails (S3)."""
    parts = F.split(line, "\t")
    fail = F.raise_error(F.concat(F.lit("not a name and a text: "), F.col(line))).cast("string")
    head = F.when(F.size(parts) == 2, parts[0]).otherwise(fail)
    name = F.split(head, " [|] ")
    return raw.select(name[0].alias("name"), F.get(name, F.lit(1)).alias("ident"), parts[1].alias("text"))


def dictionary(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """orth, lemma, interp and up to proper_type and genre; a malformed line fails."""
    names = ["orth", "lemma", "interp", "proper_type", "genre"][:columns]
    df = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names), mode="FAILFAST", quote="")
    if columns > 3:
        df = df.withColumn("proper_type", F.when(F.col("proper_type").startswith("lemma="), F.lit("")).otherwise(F.col("proper_type")))
    return df


def freq_dictionary(raw: DataFrame, line: str = "line") -> DataFrame:
    """``count orth TAB lemma TAB interp``."""
    parts = F.split(line, "\t")
    return raw.select(
        F.regexp_extract(parts[0], r"^([0-9]+) (.*)$", 2).alias("orth"),
        parts[1].alias("lemma"),
        parts[2].alias("interp"),
        F.get(parts, F.lit(3)).alias("proper_type"),
        F.regexp_extract(parts[0], r"^([0-9]+) (.*)$", 1).cast("int").alias("freq"),
    )


def split_lemma(lemma_interp: Column, parts_of_speech: tuple[str, ...]) -> Column:
    """(lemma, interp) of ``lemma:pos:...``: the lemma ends before the first known part of speech."""
    pattern = f"^(.+?):((?:{'|'.join(parts_of_speech)})(?::.*)?)$"
    return F.struct(F.regexp_extract(lemma_interp, pattern, 1).alias("lemma"), F.regexp_extract(lemma_interp, pattern, 2).alias("interp"))


def relation_pairs(spark: SparkSession, path: str, relation: int) -> DataFrame:
    """Lemma pairs of one lexical relation."""
    return spark.read.csv(path, sep="\t", schema="lemma string, lemma2 string").withColumn("relation", F.lit(relation))


def fill_sections(rows: DataFrame, keys: list[str], order: str, header: str, out: str = "section") -> DataFrame:
    """The last header at or before each row of its key, in order."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(header, ignorenulls=True).over(w))


def rule_sections(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A rule file with ``@NAME`` headers: one row per rule with its section."""
    rows = lines(spark, path).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("header", F.when(F.col("line").startswith("@"), F.substring("line", 2, 1000)))
    rows = fill_sections(rows, ["file"], "line_no", "header").filter("header is null")
    parts = F.split("line", "\t")
    return rows.select("section", *[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def expand_classes(rules: DataFrame, slots: list[str], classes: DataFrame, out: str) -> DataFrame:
    """Every slot's class name replaced by each of its symbols, joined in slot order."""
    for slot in slots:
        own = classes.select(F.col("klass").alias(slot), F.col("symbol").alias(f"{slot}_symbol"))
        rules = rules.join(own, slot)
    return rules.withColumn(out, F.concat(*[F.col(f"{s}_symbol") for s in slots]))


def union_lexicons(parts: list[DataFrame | None]) -> DataFrame:
    """Base and theory lexicons as one, absent ones skipped, the part's number kept."""
    found = [p.withColumn("theory", F.lit(i)) for i, p in enumerate(parts) if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def log_frequencies(counts: DataFrame, count_col: str = "n") -> DataFrame:
    return counts.withColumn("freq", F.log10(F.col(count_col) + 1))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.json(path, multiLine=True)


def xml_project(spark: SparkSession, path: str) -> DataFrame:
    """project/subcorpus/id elements as (project, subcorpus, id)."""
    df = spark.read.format("xml").option("rowTag", "project").schema("_name string, subcorpus array<struct<_name:string,id:array<long>>>").load(path)
    return df.select(F.col("_name").alias("project"), F.explode("subcorpus").alias("s")).select("project", F.col("s._name").alias("subcorpus"), F.explode("s.id").alias("id"))


def form_fields(df: DataFrame, url_col: str) -> DataFrame:
    """name, value of each field of a url's query, decoded."""
    query = F.regexp_extract(url_col, r"[?]([^#]*)", 1)
    rows = df.withColumn("field", F.explode(F.split(query, "&"))).filter("field <> ''")
    parts = F.split("field", "=")
    return rows.withColumns({"name": F.try_url_decode(parts[0]), "value": F.coalesce(F.try_url_decode(F.get(parts, F.lit(1))), F.lit(""))})


def tagged(edges: DataFrame, client, schema: str) -> DataFrame:
    """Edges through an external tagger: ``client`` maps an iterator of pandas frames."""
    return edges.mapInPandas(client, schema)
