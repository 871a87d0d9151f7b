"""Line dedup with a log-template tree, in DataFrame functions only.

A line is lower-cased, tokens with a digit become `<*>`, and the tree has fixed depth: token count, then the leading tokens. A leaf
may hold many templates, so its lines are looked at by bands: runs of tokens, one more than the tokens in which a line may leave its
template, so that a line shares a band with any line that has the same template's text there. Lines of one band are compared with
two of them; those that agree with one in enough tokens are one template, whose other tokens are variable fields. What neither took is
compared with all that shares a band with it. A line recurs if its masked form, or its template, stands in enough documents; recurring lines are dropped from every
document but the one with the smallest id.

Only hashes of lines are shuffled: forms are combined before the shuffle, so a line that a third of all documents share costs one
row per task; tokens (two bytes each) are looked at only in leaves that hold several forms of several documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, plain_spaces, release, unused

LEADING_TOKENS = 3
#: A line of LONG_TOKENS tokens or more recurs from LONG_DOCS documents on, one of SHORT_TOKENS or more from SHORT_DOCS on.
LONG_TOKENS, LONG_DOCS, SHORT_TOKENS, SHORT_DOCS = 8, 2, 3, 10
#: The share of a line's tokens that agree with its template.
AGREEMENT = 0.75
#: Tokens of the forms that are compared with a group's other forms at a time.
BLOCK_TOKENS = 1 << 14
_NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    """Lower-cased lines with plain spaces."""
    return F.split(plain_spaces(F.lower(text), "\t\x0b\x0c\r"), "\n")


def masked(line: Column) -> Column:
    """The tokens of a lower-cased line, those with a digit masked."""
    clean = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)
    return F.filter(F.split(clean, " "), lambda t: t != "")


def _described(line: Column) -> Column:
    """Of a line: hash of its masked form, its leaf, its token count, and its tokens as 15-bit hashes (of long lines)."""

    def of(t: Column) -> Column:
        ids = F.when(F.size(t) >= LONG_TOKENS, F.transform(t, lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFF)).cast("short"))).otherwise(F.array().cast("array<smallint>"))
        return F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.size(t), F.slice(t, 1, LEADING_TOKENS)).alias("leaf"), F.size(t).alias("n"), ids.alias("t"))

    return bind(masked(line), of)


def _describe(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """did, th and, line by line, the arrays h, leaf, n and t; written."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    arrays = bind(F.transform(lines_of(F.col("text")), _described), lambda d: F.struct(*[d.getField(c).alias(c) for c in ("h", "leaf", "n", "t")]))
    return materialize(rows.select("did", "th", arrays.alias("lines")), "lines")


def _placed(described: DataFrame, *columns: str) -> DataFrame:
    """One row per line: did, th, pos and the columns asked for."""
    zipped = F.arrays_zip(*[F.col(f"lines.{c}").alias(c) for c in columns])
    return described.select("did", "th", F.posexplode(zipped).alias("pos", "line")).select("did", "th", "pos", *[f"line.{c}" for c in columns])


def _runs(t: Column) -> Column:
    """How many parts the tokens after the leading ones are cut into: one more than the tokens in which a form may leave its template."""
    return F.floor(F.size(t) * (1 - AGREEMENT)).cast("int") + 1


def _bands(t: Column) -> Column:
    """Hashes of consecutive runs of the tokens after the leading ones."""
    free, runs = F.size(t) - LEADING_TOKENS, _runs(t)
    start = lambda i: F.ceil(i * free / runs).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.xxhash64(i, F.slice(t, start(i) + LEADING_TOKENS + 1, start(i + 1) - start(i))))


def _agree(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= AGREEMENT * F.size(a)


def _met_all(forms: DataFrame, groups: DataFrame) -> DataFrame:
    """h, keeper of the open forms that agree with another form of a group, and of that form, where several documents have them; written. groups: g, h, first, last, done, open.

    Open forms are dealt to blocks of about BLOCK_TOKENS tokens, and every form of the group meets every block: no pair is written, and a
    group of any size is spread over its forms.
    """
    rows = materialize(groups.join(forms.select("h", "t").hint("shuffle_merge"), "h"), "meeting")
    blocks = F.ceil(F.col("open") * F.size("t") / BLOCK_TOKENS)
    held = rows.where("done is null").groupBy("g", F.pmod(F.xxhash64("h"), blocks).alias("block")).agg(F.collect_list(F.struct("h", "first", "last", "t")).alias("held"))
    near = F.filter("held", lambda x: (x["h"] != F.col("h")) & _agree(x["t"], F.col("t")))
    # Of two that agree, both learn of the other's documents.
    ends = lambda h: F.transform(near, lambda x: F.struct(h(x).alias("h"), F.least(x["first"], F.col("first")).alias("keeper"), F.greatest(x["last"], F.col("last")).alias("final")))
    both = F.concat(ends(lambda x: x["h"]), ends(lambda _: F.col("h")))
    met = rows.join(held.hint("shuffle_merge"), "g").select(F.explode(both).alias("x")).select("x.*")
    out = met.groupBy("h").agg(F.min("keeper").alias("keeper"), F.max("final").alias("final")).where("keeper != final").select("h", "keeper")
    out = materialize(out, "met")
    release(rows)
    return out


def _linked(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """h, keeper of the forms that agree with a centre, and of the centres, where several documents have them; written. pairs: h, centre."""
    own = forms.select("h", "first", "last", "t")
    centres = forms.select(F.col("h").alias("centre"), F.col("first").alias("c_first"), F.col("last").alias("c_last"), F.col("t").alias("c_t"))
    linked = pairs.join(own.hint("shuffle_merge"), "h").join(centres.hint("shuffle_merge"), "centre").where(_agree(F.col("t"), F.col("c_t")))
    links = materialize(linked.select("h", "centre", "first", "last", "c_first", "c_last"), "links")
    keepers = links.groupBy("centre").agg(F.min(F.least("first", "c_first")).alias("keeper"), F.max(F.greatest("last", "c_last")).alias("final")).where("keeper != final").select("centre", "keeper")
    keepers = materialize(keepers, "keepers")
    members = links.select("h", "centre").join(keepers.hint("shuffle_merge"), "centre").select("h", "keeper").unionByName(keepers.withColumnRenamed("centre", "h"))
    out = materialize(members.groupBy("h").agg(F.min("keeper").alias("keeper")), "members")
    release(links)
    release(keepers)
    return out


def _templated(forms: DataFrame) -> DataFrame:
    """h, keeper of the forms (h, leaf, first, last, t) that belong to a recurring template of their leaf; written.

    Two forms of one template share a band. So groups are the forms that share one; a group's forms are compared with two of it, which
    takes the large templates. Forms that are still without one after that are compared with all others of their groups. So no
    pair of a template's forms is passed by; the work of the second step grows with the forms that no centre took times the forms
    that share a band with them.
    """
    rows = materialize(forms.select("h", "first", "last", F.explode(F.transform(_bands(F.col("t")), lambda b: F.xxhash64("leaf", b))).alias("g")), "bands")
    groups = rows.groupBy("g").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.where("a != b and first != last").select("g", "a", "b", "n"), "groups")
    met = rows.join(groups.hint("rebalance").hint("shuffle_merge"), "g")
    pairs = materialize(met.select("h", F.explode(F.array("a", "b")).alias("centre")).where("h != centre").distinct(), "pairs")
    found = _linked(forms, pairs)
    # The centres have met all of their group.
    left = met.where("n > 2 and h != a and h != b").select("g", "h", "first", "last").join(found.select("h", F.lit(1).alias("done")).hint("shuffle_merge"), "h", "left")
    left = materialize(left, "left")
    still = left.groupBy("g").agg(F.count("*").alias("size"), F.count_if(F.col("done").isNull()).alias("open"), F.min("first").alias("_f"), F.max("last").alias("_l")).where("size > 1 and open > 0 and _f != _l").select("g", "open")
    more = _met_all(forms, left.join(still.hint("rebalance").hint("shuffle_merge"), "g"))
    out = materialize(found.unionByName(more).groupBy("h").agg(F.min("keeper").alias("keeper")), "templated")
    for done in (rows, groups, pairs, left, found, more):
        release(done)
    return out


def _recurring(described: DataFrame) -> DataFrame:
    """h, keeper of all forms that recur; written."""
    # Of each form the place in the smallest document, as one number.
    place = F.xxhash64("did", "th", "pos").alias("place")
    long_lines = _placed(described, "h", "leaf", "n").where(F.col("n") >= LONG_TOKENS).select("h", "leaf", "did", place)
    forms = materialize(long_lines.groupBy("h", "leaf").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.min_by("place", "did").alias("place")), "forms")
    crowded = forms.groupBy("leaf").agg(F.min("h").alias("h1"), F.max("h").alias("h2"), F.min("first").alias("a"), F.max("last").alias("b")).where("h1 != h2 and a != b").select("leaf")
    within = forms.join(crowded.hint("rebalance").hint("shuffle_merge"), "leaf", "left_semi")
    tokens = _placed(described, "n", "t").where(F.col("n") >= LONG_TOKENS).select(place, "t")
    # Repeated rows have equal places.
    with_tokens = materialize(within.join(tokens.hint("shuffle_merge"), "place").select("h", "leaf", "first", "last", "t").dropDuplicates(["h"]), "tokens")
    templated = _templated(with_tokens)
    # Short lines by how many documents have them; ids count, not rows.
    short = _placed(described, "h", "n").where((F.col("n") >= SHORT_TOKENS) & (F.col("n") < LONG_TOKENS)).groupBy("h").agg(F.count_distinct("did").alias("docs"), F.min("did").alias("keeper"))
    every = short.where(F.col("docs") >= SHORT_DOCS).select("h", "keeper").unionByName(forms.where("first != last").select("h", F.col("first").alias("keeper"))).unionByName(templated.select("h", "keeper"))
    out = materialize(every.groupBy("h").agg(F.min("keeper").alias("keeper")), "recurring")
    for done in (forms, with_tokens, templated):
        release(done)
    return out


def _drops(described: DataFrame) -> DataFrame:
    """did, th, dropped (sorted positions of the lines to drop) of the texts that lose lines; written."""
    recurring = _recurring(described)
    placed = _placed(described, "h", "n").where(F.col("n") >= SHORT_TOKENS)
    drops = placed.join(recurring.hint("shuffle_merge"), "h").where("did != keeper").groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    out = materialize(drops, "drops")
    release(recurring)
    return out


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: did (id, null as the smallest long), th (hash of the text), n_lines, n_tokens, dropped (positions from 0 of the lines to drop), dropped_tokens.

    See drop_recurring_lines for the handling of odd rows.
    """
    described = _describe(docs, doc_id, text)
    # Written, so that Spark knows its size and broadcasts it only below its threshold.
    drops = _drops(described).withColumnsRenamed({"did": "_d", "th": "_t"})
    joined = described.select("did", "th", F.col("lines.n").alias("ns")).join(drops, (F.col("did") == F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    dropped, count = F.coalesce("dropped", F.array().cast("array<int>")), lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    return joined.select("did", "th", F.size("ns").alias("n_lines"), count(F.col("ns")).alias("n_tokens"), dropped.alias("dropped"), count(F.transform(dropped, lambda p: F.get("ns", p))).alias("dropped_tokens"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines and dropped (positions of the dropped lines), text without these lines, other columns as they are.

    Null texts stay null and have one empty line; lines of fewer than SHORT_TOKENS tokens never recur; a text whose lines all go
    becomes empty. Rows without an id count as one document, and so do the rows of one id; repeated rows get the same answer each,
    and lines they share with each other don't recur by that; an empty table gives no rows. Columns of docs named like the new ones
    are replaced; any other names are free.
    """
    described = _describe(docs, doc_id, text)
    d, t, gone, n = unused(docs, "_did", "_th", "_gone", "_n")
    drops = _drops(described).toDF(d, t, gone)
    release(described)
    same = (F.coalesce(docs[doc_id].cast("long"), F.lit(_NO_ID)) == F.col(d)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(t))
    joined = docs.join(drops, same, "left").withColumn(n, F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    clean = F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text))
    others = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in others], F.col(n).alias("n_lines"), F.coalesce(F.col(gone), F.array().cast("array<int>")).alias("dropped"))
