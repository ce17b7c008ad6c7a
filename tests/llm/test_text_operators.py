"""Each text operator against brute force on small fixtures, and on nulls, empty texts, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import catalog, classifier, decontaminate, line_dedup, maxplus, prob_minhash, quality_rules, scan, sentencepiece_codec, sharding, substring_dedup, token_counts, url_filters
from evenkeel.llm.components import components

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    out = [r.choice(VOCABULARY) for _ in range(n)]
    for i in range(6, n, 7):
        out[i] += "."
    return " ".join(out)


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "one", prose(60, 1), prose(60, 1), "x" * 5000, "é 漢 🙂\n\n.", "a b a b a b a b\n" * 30]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats (a whole row twice), a null id, long words, and columns that clash with results."""
    rows = [(i, t, "en", None, 0, 1, True, 2.0) for i, t in enumerate(ODD)] + [(5, ODD[5], "en", None, 0, 1, True, 2.0), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", n_words int, kept boolean, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (9, 0, 0), (77, 0, 1), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")


# -- 1 quality rules ----------------------------------------------------------------------------


def base(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_base_statistics(spark, odd):
    long = " ".join(random.Random(2).choice(VOCABULARY[:30]) for _ in range(6000))  # beyond SHORT
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100, long), (101, prose(300, 4) + "\n" + prose(40, 5) + "\n" + prose(40, 5))], "doc_id bigint, text string"))
    for r in quality_rules.base_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)


def test_rules_learn_a_threshold_and_columns_agree_with_python(spark):
    rows = [{"_label": int(i % 4 > 0), **{f: 0.0 for f in quality_rules.FEATURES}, "symbol_share": 0.5 + i / 1e4 if i % 4 == 0 else i / 1e4} for i in range(400)]
    learned = quality_rules.learn(rows)
    assert learned.rules and all(learned.rejects(r) == (r["_label"] == 0) for r in rows)
    seen = spark.createDataFrame([(r["_label"], *(r[f] for f in quality_rules.FEATURES)) for r in rows], ["_label", *quality_rules.FEATURES]).withColumn("kept", learned.verdict())
    assert seen.where(F.col("kept") != (F.col("_label") == 1)).isEmpty()
    assert quality_rules.learn([]).rules == () and str(quality_rules.learn([])) == "keep all"


def test_rules_learn_conjunctions_in_order():
    """Two kinds of bad rows, one of which only two statistics together tell; a statistic without meaning is pruned."""
    r = random.Random(7)
    rows = []
    for _ in range(3000):
        row = {f: r.random() for f in quality_rules.FEATURES}
        row["_label"] = int(not (row["bar_share"] >= 0.8 or (row["symbol_share"] >= 0.6 and row["mean_word"] < 0.3)))
        rows.append(row)
    learned = quality_rules.learn(rows)
    kinds = [{(c.feature, c.above) for c in rule} for rule in learned.rules]
    assert {("bar_share", True)} in kinds and {("symbol_share", True), ("mean_word", False)} in kinds
    assert sum(learned.rejects(x) != (x["_label"] == 0) for x in rows) < 30
    assert str(learned).count("reject if") == len(learned.rules)


def test_verdicts_on_documents_equal_python(spark):
    """The registered query: statistics and learned rules recomputed in Python."""
    data = DATA.parent / "sf0.01"
    docs, marks = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, marks))
    assert rules.rules
    for r in catalog.op1_quality_rules(spark, str(data)).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, chars, symbols, dup, again = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        t = r.text or ""
        row = {"mean_word": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "bang_share": t.count("!") / max(n, 1), "bar_share": t.count("|") / max(n, 1), "repeat_share": again / max(n, 1), "dup_line_share": dup / (1 + t.count("\n")), "stop_share": (t.count(".") + t.count(",")) / max(n, 1)}
        assert r.kept == (not r.base_failed and not rules.rejects(row))


def test_labels_of_repeated_rows_count_once(spark):
    docs = frame(spark, [prose(60, i % 3) for i in range(90)], [1] * 60 + [2] * 30)
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [(x["doc_id"], x["_label"]) for x in quality_rules.labelled_sample(docs, marks)] == [(1, 0), (2, 1)]
    assert classifier.labelled(docs, marks).count() <= 2


def test_rules_on_odd_rows(odd, labels):
    rows = quality_rules.apply_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(not r.kept for r in rows if r.base_failed) and all(r.base_failed for r in rows if not r.text)
    assert quality_rules.apply_rules(odd.limit(0), labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality_rules.apply_rules(odd, labels.limit(0)).collect())


# -- 2 substring dedup --------------------------------------------------------------------------


def test_passages(spark):
    passage = prose(63, 8)
    texts = [prose(35, 20) + " " + passage + " " + prose(35, 21), prose(35, 22) + "\n" + passage + "\n" + prose(35, 23), prose(70, 24), None, "", " ", prose(35, 20) + " end"]
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2] and got[3].text is None and got[4].text == "" and got[5].text == " "
    assert passage not in got[1].text and got[1].n_removed >= 5
    assert prose(35, 22) in got[1].text and prose(35, 23) in got[1].text


@pytest.mark.parametrize("sizes", [(4,), (1,), (9, 1, 1, 1, 1, 1)])
def test_passages_of_short_sentences(spark, sizes):
    words, sentences = prose(66, 30).split(), []
    while len(words) >= max(sizes):
        n = sizes[len(sentences) % len(sizes)]
        sentences.append(" ".join(words[:n]) + ".")
        words = words[n:]
    passage = " ".join(sentences)
    texts = [f"{prose(35, 20)}. {passage} {prose(35, 21)}.", f"{prose(35, 22)}. {passage} {prose(35, 23)}.", passage, prose(35, 24)]
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[3].text == texts[3]
    assert got[1].text == f"{prose(35, 22)}. {prose(35, 23)}." and got[2].text == ""


def test_passages_that_begin_inside_a_sentence(spark):
    r = random.Random(12)
    plain = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    cases = [(plain(60), plain(r.randint(20, 50)), plain(r.randint(20, 50))) for _ in range(60)]
    texts = [" ".join(before + passage + plain(20)) for passage, *befores in cases for before in befores]
    got = {x.doc_id: x.text.split() for x in substring_dedup.dedup_passages(frame(spark, texts)).collect()}
    lost = [len(texts[i].split()) - len(got[i]) for i in range(1, 120, 2)]
    assert all(got[i] == texts[i].split() for i in range(0, 120, 2)) and max(lost) <= 60
    assert sum(n > 0 for n in lost) >= 57 and sum(lost) / 60 >= 40


def passages_left(rows):
    """Texts of (id, text) rows by loops: units, runs, first occurrences, words that stay."""
    places, runs = {}, defaultdict(set)
    for d, t in set(rows):
        found = list(WORD.finditer(t or ""))
        w = [m[0] for m in found]
        if not w:
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        hashes = scan.hashed_words(data, np.array([0, len(data)]))[1].tolist()
        gaps = [t[x.end() : y.start()] for x, y in zip(found, found[1:])] + ["\n"]
        edges = [0]
        for i, x in enumerate(w):
            if hashes[i] % substring_dedup.CUT == 0 or x[-1] in ".!?" or re.search("[\n\x0b\x0c\r]", gaps[i]) or i + 1 - edges[-1] == substring_dedup.UNIT_WORDS:
                edges.append(i + 1)
        m = len(edges) - 1
        own = set()
        for i in range(m):
            own |= {(edges[i], edges[j]) for j in [next((j for j in range(i + 3, m + 1) if edges[j] - edges[i] >= 15), None)] if j}
            own |= {(edges[j], edges[i + 1]) for j in [next((j for j in range(i - 2, -1, -1) if edges[i + 1] - edges[j] >= 15), None)] if j is not None}
        key = (d is None, d or 0, xxhash.xxh64(t, seed=42).intdigest() & 0xFFFFFFFF)
        places[d, t] = [0, *(x.start() for x in found[1:]), len(t)]
        for a, b in own:
            runs[tuple(w[a:b])].add((key, a, b, d, t))
    gone = defaultdict(set)
    for held in runs.values():
        for _, a, b, d, t in sorted(held, key=lambda x: x[:3])[1:]:
            gone[d, t] |= set(range(a, b))
    return [("".join(t[places[d, t][i] : places[d, t][i + 1]] for i in range(len(places[d, t]) - 1) if i not in gone[d, t]) if (d, t) in places else t, len(gone[d, t])) for d, t in rows]


@pytest.mark.parametrize("gathered", [2_000_000, 5])
def test_passages_equal_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(substring_dedup, "GATHERED", gathered)
    monkeypatch.setattr(scan, "SLICE", 100)
    r = random.Random(21)
    shared = [prose(n, 60 + n) for n in (8, 20, 33, 70, 70, 15)] + ["Go. On. Up. " * 6, "é漢 🙂! " * 9]
    texts = [r.choice(["", " \n", "\x0b"]).join([prose(r.randint(1, 40), 6000 + i), " "] + [x for _ in range(r.randint(0, 3)) for x in (r.choice(shared), r.choice([" ", "\n", "\r\n"]))] + [prose(r.randint(1, 30), 7000 + i)]) for i in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (4, texts[3]), (None, texts[5]), (None, texts[6]), (None, texts[6]), (50, None), (51, ""), (52, " \n"), (53, prose(9, 1)), (54, prose(9, 1))]
    for order in (rows, rows[::-1]):
        docs = frame(spark, [t for _, t in order], [d for d, _ in order]).repartition(3)
        got = Counter((x.doc_id, x.text, x.n_removed) for x in substring_dedup.dedup_passages(docs).collect())
        want = passages_left(order)
        assert got == Counter((d, *x) for (d, _), x in zip(order, want)) and sum(n for _, n in want) > 500


def test_unique_text_under_a_repeated_id_stays(spark):
    texts = [prose(80, 91), prose(80, 92), prose(80, 91)]
    for ids in ([1, 1, 2], [2, 2, 1], [None, None, None]):
        got = [x.text for x in substring_dedup.dedup_passages(frame(spark, texts, ids)).collect()]
        assert texts[1] in got and texts[0] in got


def test_passages_on_odd_rows(odd):
    out = substring_dedup.dedup_passages(odd)
    assert out.count() == odd.count() and substring_dedup.dedup_passages(odd.limit(0)).count() == 0
    assert {r.text for r in out.where("doc_id in (0, 1, 2, 7)").collect()} == {ODD[0], ODD[1], ODD[2], ODD[7]}


# -- 3 ProbMinHash ------------------------------------------------------------------------------


def shingled(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x, y):
    if max(x.values(), default=0) == max(y.values(), default=0) == 1:
        return len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x & y)


def near_copies(n):
    out = []
    for g in range(n):
        words = prose(120, 300 + g).split()
        for k in range(4):
            other = list(words)
            for c in range(k * 2):
                other[(17 * c + 5 * g) % 120] = f"w{g}{k}{c}"
            out.append(" ".join(other))
    return out


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prob_minhash, "LARGE", 2)  # so that pruning is used
    texts = near_copies(12) + [prose(80, 50), prose(80, 50), "a b", "a  b", "", None, " ", prose(30, 60) + " " + prose(30, 60) + " tail"]
    sets = [shingled(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_classes(frame(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_similarity_is_exact():
    r = random.Random(4)
    for _ in range(50):
        x, y = (Counter({r.randint(0, 12): r.randint(1, 4) for _ in range(r.randint(1, 9))}) for _ in range(2))
        a = [np.array([k for k in sorted(s)]) for s in (x, y)]
        w = [np.array([s[k] for k in sorted(s)]) for s in (x, y)]
        assert prob_minhash.similarity(a[0], w[0], a[1], w[1]) == pytest.approx(probability_jaccard(x, y))


def test_registers_estimate_the_similarity():
    items, w = scan.mix(np.arange(1, 301, dtype=np.uint64)), np.ones(300)
    x, y = items[:250], items[50:]
    won, drawn = prob_minhash.registers(np.repeat([0, 1], 250), np.concatenate([x, y]), np.append(w[:250], w[50:]), 2, 512)
    assert (won[0] == won[1]).mean() == pytest.approx(200 / 300, abs=0.08)
    assert drawn < 2 * 512 * 20  # far fewer than every element's arrival in every register


def test_near_duplicates_on_odd_rows(odd):
    got = prob_minhash.near_duplicate_classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.class_id for r in got}
    assert by[3] == by[4] == 3 and by[5] == by[6] == 5 and by[0] == by[1] == 0 and by[2] == 2 and by[None] is None
    assert Counter(r.class_id for r in got if r.is_first) == Counter([0, 2, 3, 5, 7, 8, 9, None])
    kept = [r.doc_id for r in prob_minhash.keep_first(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [None, 0, 2, 3, 5, 7, 8, 9]))
    assert prob_minhash.near_duplicate_classes(odd.limit(0)).count() == 0


def test_texts_that_share_an_id_are_judged_each(spark):
    a, b, c = prose(90, 61), prose(90, 62), prose(90, 63)
    near = " ".join(["other", *a.split()[1:]])
    for rows in ([(1, a), (1, b), (2, near), (2, c), (3, b), (None, near), (None, prose(90, 64))],):
        for order in (rows, rows[::-1]):
            got = prob_minhash.near_duplicate_classes(frame(spark, [t for _, t in order], [i for i, _ in order])).collect()
            assert Counter((r.doc_id, r.class_id) for r in got) == Counter([(1, 1), (1, 1), (2, 1), (2, 2), (3, 1), (None, 1), (None, None)])
            kept = {r.text for r in prob_minhash.keep_first(frame(spark, [t for _, t in order], [i for i, _ in order])).collect()}
            assert kept == {a, b, c, prose(90, 64)} or kept == {near, b, c, prose(90, 64)}


def crowd(n, seed, size=150):
    """Copies of a base text, each with one changed word in 150 and up to eight more: many pairs at 0.4 to 0.8."""
    r = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for at in r.sample(range(size), 1 + r.choice([0, 0, 1, 1, 2, 2, 2, 3, 4, 8])):
            words[at] = f"n{seed}x{k}x{at}"
        out.append(" ".join(words))
    return out


def test_crowds_equal_brute_force_and_make_few_pairs(spark, monkeypatch):
    rows = []
    verify = prob_minhash._links
    monkeypatch.setattr(prob_minhash, "_links", lambda pairs, elements: (rows.append(pairs.count()), verify(pairs, elements))[1])
    texts = crowd(300, 5) + crowd(40, 6) + [x + " " + x for x in crowd(20, 7)] + crowd(20, 7)
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_classes(frame(spark, texts)).collect()}
    sets = [shingled(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i].keys() & sets[j].keys()) > 50 and root(i) != root(j) and probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) > 20
    assert len(rows) == 3 and rows[1] <= 400 and rows[2] < 10000  # of 44,850 pairs of the first crowd alone


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 2), (3, 2), (2, 2), (7, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 3: 1, 5: 5, 7: 5}
    assert components(links.limit(0)).count() == 0


# -- 4 classifier -------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs, marks = (spark.read.parquet(f"{DATA.parent}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.score(docs, marks)
    assert got.count() == docs.count()
    rows = got.join(marks, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_classifier_never_learns_from_held_out_labels(spark, labels):
    marks = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = frame(spark, [prose(20, i) for i in range(40)])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in classifier.labelled(docs, marks).collect())


def test_classifier_on_odd_rows(odd, labels):
    rows = classifier.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classifier.score(odd, labels.limit(0)).collect()} == {0.5}
    assert classifier.score(odd.limit(0), labels).count() == 0


def test_context_vectors_and_pooling_equal_loops(spark):
    texts = [prose(40, i) for i in range(6)] + ["a b", "one", "", None, "WORD!! WORD!! #x 12, a b c a b c"]
    docs = frame(spark, texts).repartition(2)
    vectors = classifier.context_vectors(docs)
    plus, minus = classifier._index_vectors()
    sums, ids_of = defaultdict(lambda: np.zeros(classifier.DIMS)), {}
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, words, marks = classifier.tokens(data, np.array([0, len(data)]))
        ids_of[t] = words, marks
        for ids in (words, marks):
            for i, a in enumerate(ids):
                for j in range(max(0, i - classifier.REACH), min(len(ids), i + classifier.REACH + 1)):
                    if j != i:
                        sums[a][plus[ids[j]]] += 1
                        sums[a][minus[ids[j]]] -= 1
    for a in range(classifier.WORDS + classifier.MARKS):
        n = np.linalg.norm(sums[a]) if a in sums else 0
        assert np.allclose(vectors[a], sums[a] / n if n else 0, atol=1e-6)
    import pyarrow as pa

    for t, row in zip(texts, classifier.pooled(pa.array(texts), vectors)):
        words, marks = ids_of[t]
        want = np.concatenate([vectors[words].mean(0), vectors[marks].mean(0), [np.log1p(len(words))]]) if len(words) else 0
        assert np.allclose(row, want, atol=1e-5)


def test_temperature_is_the_best_on_held_rows():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 5))
    y = (x[:, 0] + 1.5 * r.normal(size=900) > 0).astype(int)
    net = classifier.fit(x, y)
    held = np.arange(900) % 5 == 0
    loss = lambda t: np.mean(np.logaddexp(0, net.logit(x[held]) / t) - y[held] * net.logit(x[held]) / t)
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 16, 121))
    assert net.temperature > 1.05 or net.temperature < 0.95  # the fit alone is not calibrated


# -- 5 token counts -----------------------------------------------------------------------------


def test_histogram_answers_every_limit(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    with open(token_counts.RANKS, "rb") as file:
        own = token_counts.encoder(file.read())
    texts = [prose(n % 23, n) for n in range(60)] + [None, ""]
    n = [len(own.encode_ordinary(t)) if t else 0 for t in texts]
    table = token_counts.histogram(frame(spark, texts)).cache()
    for r in table.collect():
        c = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from) == (n.count(c), sum(x >= c for x in n), sum(x for x in n if x >= c))
        assert (r.truncated_total, r.total_tokens, r.quantile) == (sum(min(x, c) for x in n), sum(n), pytest.approx(sum(x <= c for x in n) / len(n)))
    for r in token_counts.at_limits(table, [1, 17, 1000]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(x > r.limit for x in n), sum(min(x, r.limit) for x in n))
    assert [r.n_tokens for r in token_counts.quantiles(table, [0.5, 1.0]).collect()] == [sorted(n)[(len(n) + 1) // 2 - 1], max(n)]
    assert token_counts.histogram(frame(spark, texts).limit(0)).count() == 0


# -- 6 URL filters ------------------------------------------------------------------------------


def test_url_filters_as_of(spark):
    day = lambda n: f"2024-01-{n:02d}"
    entries = [("block", "bad.org", "add", day(5)), ("block", "bad.org", "remove", day(10)), ("block", "bad.org", "add", day(20)), ("allow", "bad.org/ok/", "add", day(6)), ("block", "x.bad.org", "add", day(1)), ("block", "tie.org", "add", day(3)), ("block", "tie.org", "remove", day(3)), (None, "bad.org", "add", day(1))]
    lists = spark.createDataFrame(entries, "list string, pattern string, action string, at string").withColumn("at", F.to_date("at"))
    urls = [("http://bad.org/a", 4, False), ("http://bad.org/a", 5, True), ("http://u@WWW.Bad.org:80/a?q=/ok/", 9, True), ("http://bad.org/a", 10, False), ("http://bad.org/a", 25, True), ("http://bad.org/ok/1", 7, False), ("http://bad.org/ok", 7, True), ("http://x.bad.org", 2, True), ("http://notbad.org/", 6, False), ("http://tie.org/", 4, False), ("nonsense", 6, False), (None, 6, False), ("http://bad.org/a", None, False), ("http://bad.org/a", 5, True)]
    captures = spark.createDataFrame([(i, u, day(d) if d else None, "z") for i, (u, d, _) in enumerate(urls)], "page_id int, url string, fetched_at string, list string").withColumn("fetched_at", F.to_date("fetched_at"))
    got = {r.page_id: r.blocked for r in url_filters.judge(captures, lists).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(urls)}
    assert url_filters.judge(captures.limit(0), lists).count() == 0
    assert not any(r.blocked for r in url_filters.judge(captures, lists.limit(0)).collect())


def test_url_patterns_keep_the_case_of_paths(spark):
    lists = spark.createDataFrame([("block", "Bad.ORG/Foo/", "add", 1), ("block", "WORSE.org", "add", 1), (None, "bad.org", "add", 1)], "list string, pattern string, action string, at int")
    urls = [("http://bad.org/Foo/x", True), ("http://BAD.org/Foo/", True), ("http://bad.org/foo/x", False), ("http://bad.org/", False), ("http://a.worse.org/Foo", True)]
    captures = spark.createDataFrame([(i, u, 2) for i, (u, _) in enumerate(urls)], "page_id int, url string, fetched_at int")
    assert {r.page_id: r.blocked for r in url_filters.judge(captures, lists).collect()} == {i: b for i, (_, b) in enumerate(urls)}


def test_url_filter_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got, want = catalog.op6_url_filters(spark, str(DATA)).toPandas(), con.sql(catalog.SQL["op6_url_filters"]).df()
    order = sorted(want.columns)
    assert got[order].sort_values("page_id").values.tolist() == want[order].sort_values("page_id").values.tolist()


# -- 7 SentencePiece ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(sentencepiece_codec.MODEL, "rb") as file:
        return sentencepiece_codec.Codec(file.read())


def test_codec_equals_the_library(codec):
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(" ▁\nab é\x00the ing漢🙂\t") for _ in range(r.randint(0, 40)))
        assert codec.encode(text).tolist() == codec.library.encode(text)
        if "▁" not in text:
            assert codec.decode(codec.library.encode(text)) == text


def test_chunked_encoding_equals_the_library(spark, codec):
    texts = [prose(200, 3), "a   b  " * 200, "x" * 900, " lead", "é漢🙂 " * 90, None, "", "one\n\ntwo " * 60, "a▁b"]
    got = {r.doc_id: r for r in sentencepiece_codec.encode(frame(spark, texts), chunk=64).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == codec.library.encode(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].round_trip == ("▁" not in (t or ""))
    assert sentencepiece_codec.encode(frame(spark, texts).limit(0)).count() == 0


def test_best_path_of_a_bpe_file_is_not_its_encoding(codec):
    """Why files of that kind are not encoded by the (max, +) scan."""
    vocabulary = maxplus.Vocabulary.of(codec)
    words = ["▁" + w for w in VOCABULARY[:200]]
    other = sum(maxplus.best_path(w, vocabulary) != codec.library.encode(w[1:]) for w in words)
    assert other > 0


def as_unigram(model):
    """The given file with its model type replaced: its pieces and scores, read as a unigram vocabulary."""
    out, fields = bytearray(), sentencepiece_codec._fields

    def varint(n):
        part = bytearray()
        while n > 127:
            part.append(n & 127 | 128)
            n >>= 7
        return bytes(part) + bytes([n])

    for number, value in fields(model):
        if number == 2:
            kept = [(n, v) for n, v in fields(value) if n == 3]
            assert kept == [(3, sentencepiece_codec.BPE)]
            value = value.replace(bytes([3 << 3, sentencepiece_codec.BPE]), bytes([3 << 3, sentencepiece_codec.UNIGRAM]), 1)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return bytes(out)


def test_unigram_files_are_encoded_by_the_scan(spark, codec, tmp_path, monkeypatch):
    """On Spark, texts of many chunks and several levels: as good as the library's best path, and decoded again."""
    monkeypatch.setattr(maxplus, "FAN", 3)
    model = as_unigram(codec.model)
    own = sentencepiece_codec.Codec(model)
    assert own.scannable and not codec.scannable and sentencepiece_codec.model_kind(model) == sentencepiece_codec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(model)
    texts = [prose(150, 3), "The  state of the art, in many words. " * 12, "x" * 300, "é漢🙂 " * 40, " lead\n\nand\tmore ", None, "", "a"]
    got = {r.doc_id: r for r in sentencepiece_codec.encode(frame(spark, texts), path=str(tmp_path / "unigram.model"), chunk=40).collect()}
    sp = own.library
    total = lambda ids: sum(-1e9 if sp.is_byte(i) else sp.get_score(i) for i in ids)
    for i, t in enumerate(texts):
        ids, want = list(got[i].ids), sp.encode(t or "")
        assert total(ids) == pytest.approx(total(want)) and got[i].round_trip and got[i].n_tokens == len(ids)
        assert sp.decode(ids) == (t or "")
    assert sentencepiece_codec.encode(frame(spark, texts).limit(0), path=str(tmp_path / "unigram.model")).count() == 0


def test_tree_of_products_equals_the_chain():
    r = np.random.default_rng(8)
    ms = [r.integers(-9, 0, (4, 4)).astype(float) for _ in range(11)]
    chain = ms[0]
    for m in ms[1:]:
        chain = maxplus.compose(chain, m)
    pairs = ms
    while len(pairs) > 1:
        pairs = [maxplus.compose(*pairs[i : i + 2]) if i + 1 < len(pairs) else pairs[i] for i in range(0, len(pairs), 2)]
    assert np.array_equal(chain, pairs[0])
    for entry, leave in ((0, 0), (2, 3)):
        at = maxplus.states(ms, entry, leave)
        assert (at[0], at[-1]) == (entry, leave) and sum(m[a, b] for m, a, b in zip(ms, at, at[1:])) == chain[entry, leave]


def test_max_plus_scan_equals_the_whole():
    r = random.Random(5)
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "bb", "abb", "▁ab", "bab"]
    v = maxplus.Vocabulary({p: (i, -r.random() * 9) for i, p in enumerate(pieces)}, 99)
    for _ in range(150):
        text = "".join(r.choice("ab▁c") for _ in range(r.randint(1, 60)))
        parts = maxplus.chunks(text, r.choice([4, 5, 7]), v.width)
        matrices = [maxplus.transfer(t, n, v) for _, t, n in parts]
        at = maxplus.states(matrices)
        found = [i for (_, t, n), e, x in zip(parts, at, at[1:]) for i in maxplus.trace(t, n, v, e, x)]
        score = {i: s for i, s in v.pieces.values()}
        total = lambda ids: sum(score.get(i, v.floor) for i in ids)
        assert total(found) == pytest.approx(total(maxplus.best_path(text, v)))
        assert "".join(pieces[i] if i != 99 else "c" for i in found) == text
        whole = matrices[0]
        for m in matrices[1:]:
            whole = maxplus.compose(whole, m)
        assert whole[0, 0] == pytest.approx(maxplus.transfer(text, len(text), v)[0, 0])


# -- 8 decontamination --------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    items = [prose(n, 700 + n) for n in (5, 9, 16, 23, 34, 55, 80)] + ["too short", "", None]
    words = items[4].split()
    changed = words[:30] + ["other"] + words[31:]
    texts = [prose(40, 800 + i) + " " + (t or "") + " " + prose(33, 900 + i) for i, t in enumerate(items[:7])] + [" ".join(changed), " ".join(words[:17]), items[3].upper(), None, "", prose(200, 5), items[6]]
    benchmark = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(items)] + [(2, items[2], 1.0)], "item_id bigint, text string, similarity double")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, texts), benchmark).collect()}
    want = set()
    for d, t in enumerate(texts):
        held = Counter(shingled((t or "").lower()))
        for i, item in enumerate(items):
            s = shingled((item or "").lower())
            if len((item or "").split()) >= 5 and sum(min(c, held[k]) for k, c in s.items()) / sum(s.values()) >= 0.8:
                want.add((d, i))
    assert got.keys() == want
    assert all(abs(got[i, i].first_word - 40) <= len(items[i].split()) // 4 + 1 for i in range(7))
    assert {r.doc_id for r in decontaminate.drop_leaks(frame(spark, texts), benchmark).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find_leaks(frame(spark, texts), benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, texts).limit(0), benchmark).count() == 0


def test_leaks_with_changes_anywhere_equal_brute_force(spark):
    items = [prose(n, 1700 + n) for n in (*range(5, 39), *range(63, 80))]
    r = random.Random(13)
    texts = []
    for item in items:
        w, n = item.split(), len(item.split())
        edits = [[p] for p in range(n)] if n > 30 else [[p] for p in (0, n // 2, n - 1)]
        edits += [sorted(r.sample(range(n), k)) for k in (2, 3) if n > 60 for _ in range(6)]
        bodies = [[f"new{i}" if i in e else x for i, x in enumerate(w)] for e in edits] + [w[: n // 2] + ["put"] + w[n // 2 :], w[: n // 2] + w[n // 2 + 1 :]]
        texts += [f"{prose(r.randint(20, 40), len(texts))} {' '.join(b)} {prose(20, 5000 + len(texts))}" for b in bodies]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(frame(spark, texts), benchmark).collect()}
    held, want = [Counter(shingled(t)) for t in texts], set()
    for i, item in enumerate(items):
        s = shingled(item)
        want |= {(d, i) for d, h in enumerate(held) if sum(min(c, h[k]) for k, c in s.items()) >= 0.8 * sum(s.values())}
    assert len(want) > 1000 and got == want


def test_items_without_a_shingle_are_found_as_texts_or_lines(spark):
    short = [(1, "Too  short"), (2, "word"), (3, "one two three four"), (4, " "), (5, None)]
    texts = ["too short", "a b c\n\n too SHORT \nd", "this is too short", " word\n", "one two\nthree four", "one two three four five", "", None, "too short\n" + prose(30, 7), "words"]
    want = {(0, 1, 0), (1, 1, 3), (3, 2, 0), (4, 3, 0), (8, 1, 0)}
    for items, more in ((short, set()), (short + [(6, prose(30, 7))], {(8, 6)})):
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        got = decontaminate.find_leaks(frame(spark, texts), benchmark).collect()
        assert {(r.doc_id, r.item_id, r.first_word) for r in got if r.item_id < 6} == want and all(r.similarity == 1 for r in got)
        assert {(r.doc_id, r.item_id) for r in got if r.item_id == 6} == more and len(got) == len(want) + len(more)


def test_leaks_in_rows_that_share_an_id(spark):
    item = prose(30, 77)
    texts = [prose(50, 78), item, prose(50, 79), prose(50, 80) + " " + item, prose(50, 81)]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = frame(spark, texts + texts[::-1], [1, 1, 1, 2, 2] + [4, 4, 3, 3, 3])
    got = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and all(r.similarity == 1 for r in got)
    left = decontaminate.drop_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted((i, t) for i, t in zip([1, 1, 1, 2, 2] + [4, 4, 3, 3, 3], texts + texts[::-1]) if item not in t)
    nameless = frame(spark, texts, [None] * 5)
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(nameless, benchmark).collect()] == [(None, 1)]
    assert decontaminate.drop_leaks(nameless, benchmark).count() == 3
    two = spark.createDataFrame([(1, prose(40, 99)), (1, item), (1, item)], "item_id bigint, text string")
    for items in (two, two.orderBy("text")):
        assert sorted(r.doc_id for r in decontaminate.find_leaks(docs, items).collect()) == [1, 2, 3, 4]


def test_fingerprints_within_the_radius_share_a_block():
    r = random.Random(6)
    for _ in range(500):
        bits = [r.random() < 0.5 for _ in range(48)]
        other = list(bits)
        for k in r.sample(range(48), decontaminate.RADIUS):
            other[k] = not other[k]
        assert any(bits[b : b + 16] == other[b : b + 16] for b in (0, 16, 32))


# -- 9 sharding ---------------------------------------------------------------------------------


def test_sharding_contract(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"))
    rows = sharding.shard_documents(docs, sharding.HashTree.balanced(24)).collect()
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        text = f"é{r.doc_id}".encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += 1
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 2 * 3000 / 24 and 60 < sum(r.grown_shard == 24 for r in rows) < 190
    got = sharding.shard_documents(odd, sharding.HashTree.balanced(24)).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.doc_id == 0} == {8}
    assert sharding.shard_documents(odd.limit(0), sharding.HashTree.balanced(24)).count() == 0


def test_repeats_of_one_row_and_rows_without_a_key_get_slots_of_their_own(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(None).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.col("id")).otherwise(7).cast("string").alias("text")).repartition(5)
    rows = sharding.shard_documents(docs, sharding.HashTree.balanced(24)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 6000 and len(slots) <= 2 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r.doc_id for r in rows) == {5: 2000, None: 4000}


def test_draws_of_the_tree_recomputed(spark):
    import hashlib
    import math

    tree = sharding.HashTree(tuple(sharding.Shard(f"r{i % 3}", f"k{i % 2}", i, 1.0 + i % 4) for i in range(11))).grow(2.5)

    def least(key, children):
        draw = lambda name, w: -math.log((int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / w
        return children[0][2] if len(children) == 1 else min(children, key=lambda c: draw(c[0], c[1]))[2]

    def place(key):
        regions = defaultdict(lambda: defaultdict(list))
        for s in tree.shards:
            regions[s.region][s.rack].append(s)
        top = [(g, sum(s.weight for own in racks.values() for s in own), racks) for g, racks in regions.items()] + [(s.region, s.weight, s) for s in tree.added]
        at = least(key, top)
        if isinstance(at, sharding.Shard):
            return at.shard
        g = next(g for g, racks in regions.items() if racks is at)
        own = least(key, [(f"{g}/{k}", sum(s.weight for s in ss), ss) for k, ss in at.items()])
        k = next(k for k, ss in at.items() if ss is own)
        return least(key, [(f"{g}/{k}/{s.shard}", s.weight, s) for s in own]).shard

    got = spark.range(800).select("id", tree.assign(F.col("id").cast("string")).alias("s")).collect()
    assert all(r.s == place(str(r.id)) for r in got) and {r.s for r in got} == set(range(12))


def test_changed_weights_move_rows_only_in_changed_subtrees(spark):
    tree = sharding.HashTree.balanced(12)
    heavier = sharding.HashTree((*tree.shards[:-1], sharding.Shard(tree.shards[-1].region, tree.shards[-1].rack, 11, 2.0)))
    rows = spark.range(4000).select(tree.assign(F.col("id").cast("string")).alias("a"), heavier.assign(F.col("id").cast("string")).alias("b")).collect()
    region = {s.shard: s.region for s in tree.shards}
    assert all(region[r.b] == tree.shards[-1].region for r in rows if r.a != r.b)
    with pytest.raises(ValueError):
        sharding.HashTree.balanced(0)


# -- 10 line dedup ------------------------------------------------------------------------------


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def edited(line, r):
    k, c = r.randrange(len(line)), r.choice("xyz")
    return r.choice([line[:k] + c + line[k + 1 :], line[:k] + c + line[k:], line[:k] + line[k + 1 :]])


@pytest.mark.parametrize("small", [32, 1])
def test_lines_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)  # 1: every shared key is refined
    r = random.Random(9)
    lines = [prose(r.randint(2, 9), 40 + i) for i in range(25)] + [f"page number {i} of many pages" for i in range(12)] + ["short", "shirt", "", " "]
    lines += [edited(x, r) for x in lines[:25] for _ in range(2)] + [edited(edited(x, r), r) for x in lines[:9]]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 8))) for _ in range(60)] + [None, "", "\n\n"]
    first = {}
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                first.setdefault(x, (d, i))
    near = {b for a in first for b in first if a != b and min(len(a), len(b)) >= line_dedup.NEAR_FROM and one_edit(a, b) and first[a] < first[b]}
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not WORD.search(x) or (x not in near and first[x] == (d, i))) for d, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()} == want


def test_bounded_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    pairs = [("".join(r.choice("ab") for _ in range(r.randint(0, 7))), "".join(r.choice("ab") for _ in range(r.randint(0, 7)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for x in rows.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), k).alias("near")).collect():
            assert x.near == (distance(x.a, x.b) <= k), (x, k)


def test_short_lines_are_compared_too_where_asked(spark):
    texts = ["abc\nabd\nxyz", "ab\nq\nr", "abce\nzz"]
    got = [r.text for r in line_dedup.dedup_lines(frame(spark, texts), near_from=2).orderBy("doc_id").collect()]
    assert got == ["abc\nxyz", "q\nr", "zz"]


def test_lines_of_rows_that_share_an_id(spark):
    texts = ["first row line, of its own\nthe shared line of both", "the shared line of both\nonly in the second row"]
    for ids in ([2, 2], [None, None], [7, None]):
        for order in (texts, texts[::-1]):
            got = "\n".join(r.text for r in line_dedup.dedup_lines(frame(spark, order, ids)).collect())
            assert sorted(x for x in got.split("\n") if x) == ["first row line, of its own", "only in the second row", "the shared line of both"]
    same = line_dedup.dedup_lines(frame(spark, [texts[0]] * 2, [5, 5])).collect()
    assert [(r.text, r.n_dropped) for r in same] == [(texts[0], 0)] * 2


def test_lines_of_a_large_group_equal_brute_force(spark, monkeypatch):
    """Long lines that differ in one place of many, in length, and in two places."""
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    r = random.Random(31)
    base = prose(60, 77)
    lines = list(dict.fromkeys([base] + [edited(base, r) for _ in range(60)] + [edited(edited(base, r), r) for _ in range(60)]))
    texts = ["\n".join(lines[i::7]) for i in range(7)]
    place = {x: (i % 7, i // 7) for i, x in enumerate(lines)}
    near = {b for a in lines for b in lines if a != b and place[a] < place[b] and one_edit(a, b)}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: "\n".join(x for x in lines[i::7] if x not in near) for i in range(7)} and len(near) > 40


def test_lines_on_odd_rows(odd):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[1].text == "" and by[4].text == "" and by[None].text == "no id"
    assert by[9].n_lines == 31 and by[9].text == "a b a b a b a b\n"
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# -- scanning -----------------------------------------------------------------------------------


def test_words_across_texts_and_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scan, "SLICE", 16)
    texts = ["ab cd", None, "", "ef", "gh\tab\n", "x" * 50 + " ab"]
    data, at = scan.buffers(pa.array(texts))
    doc, hashes, _, _ = scan.hashed_words(data, at)
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    assert doc.tolist() == [i for i, _ in want]
    assert len({h for h, (_, w) in zip(hashes.tolist(), want) if w == "ab"}) == 1 and len(set(hashes.tolist())) == len({w for _, w in want})
    d, s = scan.shingles(doc, hashes, 2)
    assert Counter(d.tolist()) == Counter({0: 1, 3: 1, 4: 1, 5: 1})


@pytest.mark.parametrize("n", range(7))
def test_portions_of_few_words(spark, n):
    """Alone, and behind a text that fills a portion of its own."""
    few = " ".join(f"w{i}" for i in range(n))
    long = "abcd " * 1_000_000
    for texts in ([few], [few, None], [long, few]):
        docs = frame(spark, texts).coalesce(1)
        assert prob_minhash.near_duplicate_classes(docs).where("is_first").count() == len(set(t or "" for t in texts))
        marks = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
        assert classifier.score(docs, marks).count() == len(texts)


def test_very_long_texts(spark):
    """2.8 MB of words, and a word of 1 MB, beside short texts: every operator, whole results."""
    long, word = prose(480_000, 5), "x" * 1_000_000
    texts = [long, prose(60, 1), word, long + " end", "a b"]
    docs, marks = frame(spark, texts).repartition(2), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, " ".join(long.split()[400_000:400_040]))], "item_id bigint, text string")
    assert {r.doc_id: r.n_words for r in quality_rules.apply_rules(docs, marks).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}
    left = {r.doc_id: r.text for r in substring_dedup.dedup_passages(docs).collect()}
    assert [left[i] for i in (0, 1, 2, 4)] == [texts[i] for i in (0, 1, 2, 4)] and len(left[3]) < 200
    classes = {r.doc_id: r.class_id for r in prob_minhash.near_duplicate_classes(docs).collect()}
    assert classes == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4}
    assert classifier.score(docs, marks).count() == 5
    assert {r.doc_id for r in decontaminate.find_leaks(docs, items).collect()} == {0, 3}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == dict(enumerate(texts))
    assert all(r.round_trip for r in sentencepiece_codec.encode(docs).collect())
