from __future__ import annotations

import random

from momentlake.llm import line_dedup as L


def norm(line):
    return tuple("<*>" if any(c.isdigit() and c.isascii() for c in t) else t for t in line.lower().split())


def brute(rows):
    """Lines that recur exactly (after masking), one at a time."""
    seen = {}
    for d, t in rows:
        for key in {norm(x) for x in t.split("\n")}:
            seen.setdefault(key, set()).add(d)
    return {(d, i) for d, t in rows for i, x in enumerate(t.split("\n")) if len(k := norm(x)) >= 3 and len(seen[k]) >= (2 if len(k) >= 8 else 10) and d != min(seen[k])}


def drops(df):
    return {(r["did"], i) for r in df.collect() for i in r["dropped"]}


def test_exact_forms_against_brute_force(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}x".replace("0", "a").replace("1", "b").translate({ord(str(i)): chr(99 + i) for i in range(2, 10)}) for _ in range(n))
    common, short, stamped = fresh(20), fresh(4), fresh(9)
    rows = []
    for d in range(40):
        lines = [fresh(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6))]
        if d % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), common)
        if d % 2 == 0:
            lines.append(short)
        if d % 5 == 0:
            lines.append(f"{stamped} at 2024-01-{d:02d} id{d}")
        if d == 7:
            lines += [lines[0]] * 3
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drops(L.recurring_lines(docs)) == brute(rows)
    kept = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(docs).collect()}
    gone = brute(rows)
    assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_templates_generalise_variable_words(spark):
    names = ["anna", "bert", "cleo", "dora", "emil"]
    rows = [(i, f"this page was last edited by {n} on a sunny afternoon in may\nown text number of {n} and nothing else to tell here ok {n}{n}") for i, n in enumerate(names)]
    rows.append((9, "this page was found in a quite different book that nobody reads any more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(d, 0) for d in range(1, 5)} <= drops(L.recurring_lines(docs)) and not any(d in (0, 9) for d, _ in drops(L.recurring_lines(docs)))


def test_several_templates_among_many_unrelated_lines_of_a_leaf(spark):
    """All lines have 16 tokens and begin alike; the words of the unrelated ones come from a small vocabulary."""
    rng = random.Random(5)
    common = ["of", "and", "to", "in", "it", "was", "for", "on"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(2))
    patterns = [
        "this page was last edited by {} on a sunny afternoon in {} of the year", "this page was written by {} for the weekly club and {} who pays its fee",
        "this page was moved to another address where {} keeps it for {} and some friends",
    ]
    names = ["anna", "bert", "cleo", "dora", "emil", "finn", "gwen", "hugo"]
    lines = [p.format(n, names[(j * 3 + k) % 8]) for k, p in enumerate(patterns) for j, n in enumerate(names[: 3 + 2 * k])]
    lines = [" ".join((x.split() + ["end"] * 16)[:16]) for x in lines]
    rows = [(i, "this page was " + " ".join(word() for _ in range(13))) for i in range(400)]
    rows += [(1000 + i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drops(L.recurring_lines(docs)) == {(1000 + i, 0) for i in range(len(lines)) if i not in (0, 3, 8)}


def test_ids_count_not_rows(spark):
    """Nine copies of one row and one other document are two documents; copies of a row don't outvote its leaf."""
    copies = [(1, "a short line here\nsomething of its own")] * 9 + [(2, "a short line here\nother")]
    assert drops(L.recurring_lines(spark.createDataFrame(copies, "doc_id long, text string"))) == set()
    template = "the daily report of {} was sent to all members of the board today"
    rows = [(i, template.format(n)) for i, n in enumerate(("anna", "bert", "cleo", "dora", "emil", "finn"))] + [(50, "the daily report is a book that nobody of us wants to read again")] * 20
    assert drops(L.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == {(i, 0) for i in range(1, 6)}
    one_id = [(3, template.format(n)) for n in ("anna", "bert", "cleo")]
    assert drops(L.recurring_lines(spark.createDataFrame(one_id, "doc_id long, text string"))) == set()


def test_recall_of_planted_templates(spark):
    """Templates of 9 to 60 words with up to a fifth of their words variable, among unrelated lines; the planted lines go, others stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    rows, planted, first = [], set(), set()
    for n in (9, 12, 20, 35, 60):
        for _ in range(6):
            pattern = [word() for _ in range(n)]
            fields = rng.sample(range(3, n), max(1, n // 8))
            for j in range(5):
                line = [word() if i in fields else w for i, w in enumerate(pattern)]
                d = len(rows)
                (first if j == 0 else planted).add((d, 1))
                rows.append((d, "\n".join([" ".join([*pattern[:3], *(word() for _ in range(n - 3))]), " ".join(line)])))
    got = drops(L.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert not got - planted and len(got) >= 0.98 * len(planted), (len(got), len(planted))


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("id", "did")
    out = L.drop_recurring_lines(clash)
    assert out.columns == [*clash.columns, "n_lines", "dropped"] and out.count() == clash.count()
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in clash.collect())
    assert L.drop_recurring_lines(no_docs).count() == 0
    names = {"lang": "_dropped", "source": "_n", "n_chars": "_line_did", "id": "_gone"}
    assert L.drop_recurring_lines(odd_docs.withColumnsRenamed(names)).count() == odd_docs.count()


def crowded(rng, templates, fields, docs=6):
    """Templates of 12 words that begin and end alike and have a variable word in each band but the last; a document per line."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, planted = [], set()
    for _ in range(templates):
        pattern = ["see", "all", "news", *(word() for _ in range(7)), "read", "more"]
        for j in range(docs):
            if j:
                planted.add((len(rows), 0))
            rows.append((len(rows), " ".join(word() if i in fields else w for i, w in enumerate(pattern))))
    return rows, planted


def test_many_templates_that_share_a_band_are_all_found(spark):
    rng = random.Random(8)
    for templates, fields in ((20, (5, 7, 9)), (20, (4, 6, 8)), (200, (5, 7, 9))):
        rows, planted = crowded(rng, templates, fields)
        assert drops(L.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == planted


def test_lines_of_one_leaf_against_all_pairs(spark):
    """Lines from few words, so that many agree in part: exactly those go that agree in three quarters of their words with another document's."""
    rng = random.Random(4)
    rows = [(i, "one two three " + " ".join(rng.choice("abcd") for _ in range(9))) for i in range(160)]
    words = [t.split() for _, t in rows]
    agree = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) >= 9
    near = {i for i in range(160) if any(i != j and agree(words[i], words[j]) for j in range(160))}
    got = {d for d, _ in drops(L.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))}
    # Of each group a line stays; which lines make a group is a matter of its centres.
    assert got <= near and all(i in got or all(j in got or not agree(words[i], words[j]) for j in range(160) if j != i) or any(agree(words[i], words[j]) and j in got for j in range(160) if j != i) for i in near)
    assert len(near - got) < len(near) / 2
