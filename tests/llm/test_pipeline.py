"""The stages on the smallest tables: columns, what each may remove, and rows that must not crash it."""

import sys
from pathlib import Path

from collections import Counter, defaultdict

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from evenkeel.llm import decontaminate, line_dedup, quality_rules, sentencepiece_codec
from evenkeel.llm.common import durable
from test_text_operators import WORD, base, one_edit, probability_jaccard, shingled

DATA = str(Path("/root/testdata/sf0.001"))


def test_stages_keep_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, DATA))
        left = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and set(left) <= ids and len(left) == len(set(left)), name
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name == "quality rules"
        ids = set(left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == ids and all(r.round_trip for r in last)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", None, None, 3), (3, "w " * 100, "en", "s", 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stage(spark, docs, DATA).count() <= len(rows)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def kept_by_rules(spark, docs):
    rules = quality_rules.learn(quality_rules.labelled_sample(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")))
    out = {}
    for d, t in docs.items():
        n, chars, symbols, dup, again = base(t)
        row = {"mean_word": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "bang_share": t.count("!") / max(n, 1), "bar_share": t.count("|") / max(n, 1), "repeat_share": again / max(n, 1), "dup_line_share": dup / (1 + t.count("\n")), "stop_share": (t.count(".") + t.count(",")) / max(n, 1)}
        if n >= 50 and 100 * again <= 50 * n and not rules.rejects(row):
            out[d] = t
    return out


def without_repeated_lines(docs):
    first, by_length = {}, defaultdict(list)
    for d, t in sorted(docs.items()):
        for i, x in enumerate(t.split("\n")):
            if WORD.search(x) and x not in first:
                first[x] = (d, i)
                by_length[len(x)].append(x)
    gone = {b for n, own in by_length.items() if n >= line_dedup.NEAR_FROM for b in own for k in (n - 1, n, n + 1) if k >= line_dedup.NEAR_FROM for a in by_length.get(k, ()) if first[a] < first[b] and one_edit(a, b)}
    out = {}
    for d, t in docs.items():
        left = [x for i, x in enumerate(t.split("\n")) if not WORD.search(x) or (x not in gone and first[x] == (d, i))]
        if len(left) == len(t.split("\n")) or "\n".join(left):
            out[d] = "\n".join(left)
    return out


def one_of_each_class(docs):
    sets, parent = {d: shingled(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def without_items(docs, items):
    out = {}
    for d, t in docs.items():
        held = shingled(t.lower())
        if not any(sum(min(c, held[k]) for k, c in s.items()) >= 0.8 * s.total() for s in items):
            out[d] = t
    return out


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [shingled(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) >= 5]
    want = without_items(one_of_each_class(without_repeated_lines(kept_by_rules(spark, docs))), items)
    with open(sentencepiece_codec.MODEL, "rb") as file:
        library = sentencepiece_codec.Codec(file.read()).library
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {d: library.encode(t) for d, t in want.items()} and 0 < len(want) < len(docs)
    assert Counter(r.doc_id for r in got).most_common(1)[0][1] == 1 and decontaminate.THRESHOLD == 0.8
