from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from momentlake.llm import packing

from .test_decontamination import jaccard
from .test_line_dedup import norm
from .test_near_dups import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_run_matches_them(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > counts[4]
    by_stage = sorted(map(tuple, docs.collect()))
    assert by_stage == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    total = sum(r["length"] for r in docs.collect())
    last = spark.read.parquet(f"{tmp_path}/decontamination").collect()
    words, path = [w for r in last for w in r["text"].encode().split()], packing.tokenizer_file(packing.TOKENIZER)
    assert total == len(last) + sum(len(np.frombuffer(x, "<u4")) for x in packing.encode_words(words, path))


def test_stages_bear_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for i, docs in enumerate((odd_docs.drop("id"), no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{i}-{name}")


def test_stages_against_brute_force(spark, tmp_path):
    """A small corpus with recurring lines, near copies, leaks, foreign junk and repeated ids, stage by stage against plain Python."""
    rng = random.Random(21)
    tongues = {"aa": "the ing ou th er and wh".split(), "bb": "sch ein ung keit zu lich der".split()}
    word = lambda x: "".join(rng.choice(tongues[x]) for _ in range(rng.randrange(2, 5)))
    line = lambda x, n: " ".join(word(x) for _ in range(n))
    items = [line("aa", n) for n in (6, 18, 40)]
    notice, short = line("aa", 14), line("bb", 4)
    rows = []
    for d in range(90):
        x = rng.choice(list(tongues))
        lines = [line(x, rng.randrange(10, 40)) for _ in range(rng.randrange(1, 5))]
        lines += [notice] * (d % 4 == 0) + [short] * (d % 3 == 0) + [f"{items[d // 9 % 3]} {line(x, 5 + d)}"] * (d % 9 == 5)
        rows.append([d, "\n".join(lines), x])
    for d in (3, 10, 11, 20):  # near copies: a word more, and an exact copy under a repeated id
        rows.append([100 + d, rows[d][1].replace("\n", "\n" + word("aa") + " ", 1), rows[d][2]])
    rows += [[7, rows[12][1], rows[12][2]], [200, "?! 12 -- 34", None], [201, None, "aa"], [202, "", "bb"]]
    docs = spark.createDataFrame([(d, t, x, "s", 0) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    step = lambda name, df: corpus_pipeline.materialize(stages[name](spark, df, str(tmp_path)), name)

    known = step("language_id", docs)
    model = corpus_pipeline.language.fit(docs, usable=corpus_pipeline.in_three(F.col("doc_id"), 3) != 1)
    accepted = {(r["doc_id"], r["lang_pred"]) for r in corpus_pipeline.language.identify(docs, model).collect() if not r["rejected"]}
    want = sorted((d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t) and any(a == d for a, _ in accepted))
    assert texts(known) == want and not {200, 201, 202} & {d for d, _ in want}

    gone = brute_lines(want)
    want = sorted((d, t) for d, t in ((d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone)) for d, t in want) if t.split())
    clean = step("line_dedup", known)
    assert texts(clean) == want and gone

    want = one_of_each(want)
    single = step("near_dedup", clean)
    assert texts(single) == want

    def leaks(text):
        words = text.lower().split()
        return any(jaccard(words[max(0, s) : s + len(i.split())], i.split()) >= 0.8 for i in items for s in range(-len(i.split()) // 4, len(words)))

    left = [(d, t) for d, t in want if not leaks(t)]
    pure = step("decontamination", single)
    assert texts(pure) == left and len(left) < len(want)

    lengths = {}
    for r in step("packing", pure).collect():
        lengths.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert sorted(lengths) == sorted({d for d, _ in left})
    for d, pieces in lengths.items():
        if sum(x == d for x, _ in left) == 1:
            assert sum(n for _, n, _ in pieces) == pieces[0][2] and min(s for s, _, _ in pieces) == 0


def brute_lines(rows):
    """(id, text, position) of lines that recur exactly; ids count, and the smallest keeps its lines."""
    seen = {}
    for d, t in rows:
        for key in {norm(x) for x in t.split("\n")}:
            seen.setdefault(key, set()).add(d)
    return {(d, t, i) for d, t in rows for i, x in enumerate(t.split("\n")) if len(k := norm(x)) >= 3 and len(seen[k]) >= (2 if len(k) >= 8 else 10) and d != min(seen[k])}


def one_of_each(rows):
    """Of each group of near copies (five-word shingles, 0.8) the row of the smallest id."""
    named = list(enumerate(rows))
    group = {i: c for i, (_, c) in brute([(i, t) for i, (_, t) in named], 5).items()}
    first = {}
    for i, (d, t) in named:
        first.setdefault(group[i], []).append((d, t))
    return sorted(min(g, key=lambda r: r[0]) for g in first.values())
