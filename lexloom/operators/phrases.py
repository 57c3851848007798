"""Phrases and frames: alignment, tagging, ordering, frame variants and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --- phrase alignment: arrays pre, vis, post (W13) --------------------------------------


def starts_with_term(symbols: Column, term: list[str]) -> Column:
    return F.slice(symbols, 1, len(term)) == F.array(*map(F.lit, term))


def term_to_pre(rows: DataFrame, term: list[str]) -> DataFrame:
    """A term that begins ``vis`` moves to the end of ``pre``."""
    hit = starts_with_term(F.col("vis"), term)
    rest = F.slice("vis", len(term) + 1, F.size("vis"))
    return rows.withColumns({"pre": F.when(hit, F.concat("pre", F.slice("vis", 1, len(term)))).otherwise(F.col("pre")), "vis": F.when(hit, rest).otherwise(F.col("vis"))})


def from_term_to_post(rows: DataFrame, term: list[str]) -> DataFrame:
    """What stands behind the first occurrence of a term in ``vis`` moves to the start of ``post``."""
    n = len(term)
    last = F.size("vis") - n + 1
    places = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.when((last >= 1) & (F.slice("vis", i, n) == F.array(*map(F.lit, term))), i)), lambda x: x.isNotNull())
    cut = F.get(places, F.lit(0)) + n - 1
    tail = F.slice("vis", cut + 1, F.size("vis"))
    return rows.withColumn("__cut", cut).withColumns(
        {"post": F.when(F.col("__cut").isNotNull(), F.concat(tail, "post")).otherwise(F.col("post")), "vis": F.when(F.col("__cut").isNotNull(), F.slice("vis", 1, F.col("__cut"))).otherwise(F.col("vis"))}
    ).drop("__cut")


def shift(rows: DataFrame, to_pre: int = 0, to_post: int = 0) -> DataFrame:
    """The first ``to_pre`` and the last ``to_post`` symbols of ``vis`` move outwards, as far as there are any."""
    n = F.size("vis")
    a = F.least(F.lit(to_pre), n)
    b = F.least(F.lit(to_post), n - a)
    return rows.select(
        *[c for c in rows.columns if c not in ("pre", "vis", "post")],
        F.concat("pre", F.slice("vis", F.lit(1), a)).alias("pre"),
        F.slice("vis", a + 1, n - a - b).alias("vis"),
        F.concat(F.slice("vis", n - b + 1, b), "post").alias("post"),
    )


def typed_json(rows: DataFrame, column: str, ddl: str) -> DataFrame:
    """JSON against a schema: ``typed`` is true if every named field is there with its type and no other is."""
    got = F.from_json(column, ddl)
    keys = F.json_object_keys(column)
    names = [f.split(":")[0].split()[0] for f in ddl.split(",")]
    fits = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0, F.lit(False))
    for n in names:
        fits = fits & F.coalesce(got[n].isNotNull(), F.lit(False))
    return rows.withColumn("typed", fits)


# --- analyses ---------------------------------------------------------------------------


def suffix_entries(forms: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Forms that are a listed suffix (L4): a broadcast-sized equi-join."""
    return forms.join(suffixes, "orth")


def numbered(analyses: DataFrame, keys: list[str], ranks: list[tuple[str, list[str]]], then: list[str]) -> DataFrame:
    """Place of each analysis within its key by lists of values, listed ones first in list order."""
    order = []
    for column, listed in ranks:
        place = F.lit(len(listed))
        for i, v in reversed(list(enumerate(listed))):
            place = F.when(F.col(column) == v, i).otherwise(place)
        order.append(place)
    return analyses.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order, *then)))


def inflection_class(forms: DataFrame, lemma: str = "lemma") -> DataFrame:
    """Whether a lemma has forms besides itself, and its genders (L22). forms: lemma, orth, gender."""
    return forms.groupBy(lemma).agg(
        F.bool_or(F.col("orth") != F.col(lemma)).alias("inflected"), F.array_join(F.sort_array(F.collect_set("gender")), ".").alias("genders")
    )


def by_rule_score(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Analyses of best 10**6 * length of the ending + frequency, ties kept."""
    rows = analyses.withColumn("score", F.length("find") * 1_000_000 + F.col("freq"))
    best = rows.groupBy(*keys).agg(F.max("score").alias("__best"))
    return rows.join(best, keys).filter("score = __best").drop("__best")


def canonical(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each phrase by its first fitting pattern: its head and the rest as modifiers.

    tokens: phrase_id, pos (1-based), orth, tag. patterns: priority, tags (joined by spaces), head (1-based).
    """
    flat = tokens.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "orth", "tag"))).alias("t"))
    flat = flat.select("phrase_id", "t.orth", F.array_join("t.tag", " ").alias("tags"))
    first = patterns.groupBy("tags").agg(F.min_by("head", "priority").alias("at"), F.min("priority").alias("priority"))
    hit = flat.join(first, "tags")
    head = F.element_at("orth", F.col("at"))
    rest = F.filter("orth", lambda x, i: i + 1 != F.col("at"))
    return hit.select("phrase_id", "priority", head.alias("head"), F.array_join(rest, " ").alias("modifiers"))


def derived_tag(tag: Column) -> Column:
    """Gerunds as nouns, participles as adjectives."""
    return F.when(tag.startswith("ger:"), F.regexp_replace(tag, r"^ger:([^:]*):([^:]*).*$", "subst:$1:$2:n:col")).when(
        tag.rlike("^(pact|ppas):"), F.regexp_replace(tag, r"^(?:pact|ppas):([^:]*):([^:]*):([^:]*).*$", "adj:$1:$2:$3:pos")
    ).otherwise(tag)


# --- frames and arguments ----------------------------------------------------------------


def ordered_arguments(args: DataFrame, parent: str, position: str, label: str) -> DataFrame:
    """Arguments of a node by their place in the text (Q2)."""
    return args.groupBy(parent).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, label))), lambda x: x[label].cast("string")), ",").alias("arguments"))


def abbreviated(values: DataFrame, keys: list[str], value: str, short: dict[str, str]) -> DataFrame:
    """A node's set of values by a table of sets (``a.b.c``) to abbreviations; the full set's may be empty (Q11)."""
    table = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    got = values.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), ".").alias("__v"))
    return got.select(*keys, F.coalesce(F.element_at(table, F.col("__v")), F.col("__v")).alias("value"))


def concepts(nodes: DataFrame, coercions: DataFrame) -> DataFrame:
    """Nodes with the relation path that fits their category to what is wanted (Q6): equal, coerced or none.

    nodes: cat, wanted and more. coercions: cat, cat2, path.
    """
    paths = coercions.select("cat", F.col("cat2").alias("wanted"), "path")
    got = nodes.join(paths, ["cat", "wanted"], "left")
    return got.withColumn("fit", F.when(F.col("cat") == F.col("wanted"), "equal").when(F.col("path").isNotNull(), "coerced").otherwise("none"))


def substituted(rules: DataFrame, frames: DataFrame) -> DataFrame:
    """Rules with a schema slot by the frames of their part of speech whose value sets meet.

    An equi-join on the part of speech, then the sets' test; rules: rule_id, pos, values, category with ``SCHEMA``;
    frames: frame_id, pos, values, rendered. An empty set meets any.
    """
    both = rules.select("rule_id", "pos", F.col("values").alias("a"), "category").join(frames.select("frame_id", "pos", F.col("values").alias("b"), "rendered"), "pos")
    both = both.filter((F.size("a") == 0) | (F.size("b") == 0) | F.arrays_overlap("a", "b"))
    kept = F.when(F.size("a") == 0, F.col("b")).when(F.size("b") == 0, F.col("a")).otherwise(F.array_intersect("a", "b"))
    return both.select("rule_id", "frame_id", F.array_join(F.array_sort(kept), ".").alias("values"), F.replace("category", F.lit("SCHEMA"), F.col("rendered")).alias("category"))


def transformed_frames(frames: DataFrame, variants: DataFrame) -> DataFrame:
    """Frames rewritten for a part of speech, a row for each variant (V5).

    frames: frame_id, pos, positions (array of (role, phrase)). variants: pos, variant, role, phrase, phrase2 (null drops
    the position): what becomes of a role's phrase in that variant; positions without an entry stay.
    """
    rows = frames.select("frame_id", "pos", F.posexplode("positions").alias("at", "p")).select("frame_id", "pos", "at", "p.role", "p.phrase")
    names = variants.select("pos", "variant").distinct()
    change = variants.withColumn("__hit", F.lit(True))
    got = rows.join(names, "pos").join(change, ["pos", "variant", "role", "phrase"], "left")
    got = got.withColumn("phrase", F.when(F.col("__hit"), F.col("phrase2")).otherwise(F.col("phrase"))).filter("phrase is not null")
    flat = got.groupBy("frame_id", "pos", "variant").agg(F.array_sort(F.collect_list(F.struct("at", "role", "phrase"))).alias("p"))
    return flat.select("frame_id", "pos", "variant", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["role"], x["phrase"])), ",").alias("positions"))


def rendered(head: Column, positions: Column) -> Column:
    """A frame as a category: the head with an argument for each position, to the left or right (V6).

    positions: array of (phrase, direction) with ``>``, ``<`` or both.
    """
    wrap = lambda c: F.when(c.rlike(r"[/\\]"), F.concat(F.lit("("), c, F.lit(")"))).otherwise(c)
    step = lambda out, p: F.concat(wrap(out), F.when(p["direction"] == "<", "\\").otherwise("/"), wrap(p["phrase"]))
    return F.aggregate(positions, head, step)


def artificial_tokens(tokens: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows for nodes without one, numbered behind their sentence's last (V8). tokens: keys, id. nodes: keys, label."""
    last = tokens.groupBy(*keys).agg(F.max("id").alias("__last"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("label"))
    return nodes.join(last, keys, "left").select(*keys, (F.coalesce("__last", F.lit(0)) + place).cast("long").alias("id"), "label")


def coordination_marks(edges: DataFrame, args: DataFrame, depth: int) -> DataFrame:
    """How many coordinated edges open and close at each edge below them (M9): ``depth`` rounds of an equi-join.

    edges: id, coordinated. args: parent, child, first, last (whether the child is the parent's first or last).
    """
    open_ = edges.filter("coordinated").select(F.col("id").alias("top"), F.col("id").alias("node"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    out = []
    for _ in range(depth):
        below = open_.join(args, open_["node"] == args["parent"])
        open_ = below.select("top", F.col("child").alias("node"), (F.col("left") & F.col("first")).alias("left"), (F.col("right") & F.col("last")).alias("right")).filter("left or right")
        out.append(open_)
    marks = out[0]
    for more in out[1:]:
        marks = marks.unionByName(more)
    return marks.groupBy("node").agg(F.count_if("left").alias("opens"), F.count_if("right").alias("closes"))
