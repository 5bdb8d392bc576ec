"""Near duplicates, language, toxicity and the pipeline against plain Python and held-out labels."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tillgrid.llm import common, components, language_id, near_duplicates, toxicity

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows, percent):
    sets = [(d, plain_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        (_, a), (_, b) = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = find(pair[0]), find(pair[1])
            root[max(x, y)] = min(x, y)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        names[find(i)].append(d)
    name = {r: min((d for d in ds if d is not None), default=None) for r, ds in names.items()}
    return collections.Counter((d, len(s), name[find(i)], d == name[find(i)]) for i, (d, s) in enumerate(sets))


def got(df):
    return collections.Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(500, x) for x in range(501, 600)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got.get(node, node) == min(seen)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark, edge, no_documents):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert got(near_duplicates.find(edge, 85)) == plain_components(rows, 85)
    assert near_duplicates.find(no_documents).count() == 0
    kept = near_duplicates.kept_documents(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id in (9, 11)").count() == 0


def test_estimate_misses_no_more_than_stated():
    from fractions import Fraction
    from math import comb
    k = near_duplicates.SKETCH
    for percent in (50, 80, 85, 95):
        t, least = Fraction(percent, 100), round(near_duplicates.least_estimate(percent) * k)
        below = [sum(comb(k, i) * t ** i * (1 - t) ** (k - i) for i in range(c)) for c in (least, least + 1)]
        assert below[0] <= Fraction(1, 3_000_000) < below[1]


def test_near_duplicates_groups(spark, monkeypatch):
    """Groups whose copies drift apart, chains, and a passage that all documents share; also with long lists in several blocks."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(60)], []
    for group in range(12):
        base = [word() for _ in range(rng.choice((12, 60, 150, 300)))]
        for copy in range(60 if group < 2 else 8):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
            base = text if group % 3 == 0 else base
    rows += [(len(rows) + i, " ".join([*passage, *(word() for _ in range(rng.randrange(2, 40)))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        want = plain_components(rows, percent)
        assert got(near_duplicates.find(docs, percent)) == want
    monkeypatch.setattr(near_duplicates, "SHORT_LIST", 3)
    monkeypatch.setattr(near_duplicates, "HUB_ROWS", 7)
    assert got(near_duplicates.find(docs, 85)) == want


def test_long_lists_of_documents_set_from_the_same_passages(spark, monkeypatch):
    """Classes of equal frequent shingles, classes that overlap each other, and members that only reach another class's smallest node."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(9000)}"
    passages, rows = [[word() for _ in range(n)] for n in (40, 40, 30, 12, 8, 6)], []
    for i in range(260):
        text = list(passages[i % 2]) + (passages[2] if i % 3 else [])
        for p in passages[3:]:
            text += p if rng.random() < 0.5 else []
        rows.append((i, " ".join(text + [word() for _ in range(rng.choice((0, 1, 3, 6, 9, 14, 20, 30)))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, 85)
    assert len({c for _, _, c, _ in want}) > 20
    for short in (2, 8):
        monkeypatch.setattr(near_duplicates, "SHORT_LIST", short)
        assert got(near_duplicates.find(docs, 85)) == want


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Copies that drift apart from one text: pairs that can't reach the threshold make no rows, linked ones all do."""
    rng, made = random.Random(11), []
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(300):
        at = sorted(rng.sample(range(0, 160, 8), rng.choice((2, 4, 6, 8))))  # whole stretches are left out, so few words are rare
        rows.append((i, " ".join(w for k, w in enumerate(base) if not any(a <= k < a + 5 for a in at))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common = near_duplicates._common

    def counted(pairs, sets):
        made.append((pairs.count(), common(pairs, sets).filter("100 * common >= 85 * (na + nb - common)").count()))
        return common(pairs, sets)
    monkeypatch.setattr(near_duplicates, "_common", counted)
    assert got(near_duplicates.find(docs, 85)) == plain_components(rows, 85)
    candidates, links = map(sum, zip(*made, strict=True))
    assert 10 < links <= candidates < 20 * links, made


def test_hot_ids_and_rows_without_id(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(400)}"
    base = [word() for _ in range(80)]
    middle = base[:-4] + [word() for _ in range(4)]
    chain = [base, middle, [word() for _ in range(4)] + middle[4:]]  # the first and the last are linked over the row without id alone
    rows = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (2, " ".join(chain[2])), (1, "clean text of the same id as a copy " * 3)]
    rows += [(77, " ".join(word() for _ in range(30))) for _ in range(600)] + [(78, " ".join(base))] * 3 + [(None, "a row without an id")] * 2
    docs = spark.createDataFrame([(d, t, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, `row` string, mark long")
    assert got(near_duplicates.find(docs, 85)) == plain_components(rows, 85)
    kept = near_duplicates.kept_documents(docs, 85)
    assert kept.columns == docs.columns and kept.filter("`row` <> text").count() == 0
    texts = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    roots = plain_components(rows, 85)  # one row of each component, by content: the texts but the chain's and the copies'
    assert max(texts.values()) == 1 and (1, " ".join(base)) in texts and (78, " ".join(base)) not in texts and (2, " ".join(chain[2])) not in texts
    assert len(texts) == 1 + 1 + 600 + 1 and sum(roots.values()) == len(rows)


def plain_code_length(counts, text):
    """PPM code length straight from the definition; ``counts``: context -> Counter of next bytes."""
    data, bits = b"\n" * language_id.ORDER + text, 0.0
    for i in range(language_id.ORDER, len(data)):
        for k in range(language_id.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(data[i - k:i])
            if seen is None:
                continue
            total, distinct, n = sum(seen.values()), len(seen), seen.get(data[i], 0)
            if n:
                bits -= math.log2(n / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
    return bits


def test_code_lengths(spark, monkeypatch):
    learn = {"aa": ["abra cadabra", "bar"], "bb": ["xyz zyx é", "Yx"]}
    sample = spark.createDataFrame([(lang, t) for lang, ts in learn.items() for t in ts], "lang string, text string")
    rows = language_id.count_contexts(sample).toPandas()
    model = language_id.Model((rows["lang"].tolist(), rows["k"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()))
    trees = {}
    for lang, texts in learn.items():
        tree = trees[lang] = collections.defaultdict(collections.Counter)
        for t in texts:
            data = b"\n" * language_id.ORDER + language_id.folded(t)
            for i in range(language_id.ORDER, len(data)):
                for k in range(language_id.ORDER + 1):
                    tree[data[i - k:i]][data[i]] += 1
    texts = [language_id.folded(t) for t in ("abra", "", "zyx é ü", "cab bar\n日本", "q" * 50, "abracadabra " * 9)]
    want = [[plain_code_length(trees[x], t) for x in model.langs] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(language_id, "CHUNK", 5)
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)


def test_language(spark, edge, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in language_id.identify(edge).collect()}
    assert [found[d].lang_pred for d in (1, 2, 3, 12)] == ["und"] * 4 and found[4].lang_pred == "en"
    assert language_id.identify(no_documents).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    # Neither lang nor source nor doc_id is an input of a prediction.
    model = language_id.train(docs.filter(~language_id.held_out()).select("doc_id", "lang", "text"))
    moved = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text")
    a, b = ({(r.doc_id - k): r.lang_pred for r in language_id.predict(d, model).collect()} for k, d in ((0, docs), (1, moved)))
    assert a == b


def test_many_languages_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    rows = [(i, f"l{i % 9 if i % 2 else i % 3}", f"words of language {i % 9} number {i}") for i in range(300)] + [(7, "l1", "one hot row")] * 3000
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert {r.lang for r in sample.collect()} == {"l0", "l1", "l2"} and sample.filter("text = 'one hot row'").count() <= 1


def test_labelled_rows_once_and_by_class(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"words {i}") for i in range(2, 90)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(1, 400)] + [(2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    sample, there = toxicity.labelled_sample(docs, labels, 20)
    rows = sample.collect()
    assert there == {True: 9, False: 80} and sum(r.toxic for r in rows) == 9 and len(rows) == 19
    assert sum(r.text.startswith("text") for r in toxicity.labelled_sample(docs, labels, 1000)[0].collect()) == 1


def test_ordinal_fit():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2)) * 10
    grades = np.digitize(x[:, 0] + rng.logistic(0, 0.5, 3000), [3, 5, 8])
    weights, thresholds = toxicity.fit([{0: a, 1: b} for a, b in x], grades, 2)
    assert weights[0] > 5 * weights[1] and (np.diff(thresholds) > 0).all()
    assert np.allclose(thresholds / weights[0], [3, 5, 8], atol=0.4)


def test_toxicity(spark, edge, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.grade(docs, model).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    toxic = [r for r in rows if r.label]
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic) and sum(r.toxic for r in rows if not r.label) <= 0.01 * len(rows)
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in rows)
    assert toxicity.grade(edge, model).count() == edge.count() and toxicity.grade(no_documents, model).count() == 0
    blank = toxicity.train(docs.limit(50), labels.limit(0))
    assert toxicity.grade(edge, blank).filter("toxic").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now, counts = [n for n, _ in corpus_pipeline.STAGES], docs, []
    assert names == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        after = common.settle(stage(spark, now, SF), name)
        counts.append(after.count())
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
            want = sorted(d for d, _, _, kept in plain_components(rows, 80).elements() if kept)
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == want
        if name != names[-1]:
            assert after.columns == docs.columns
            now = after
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    ran = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(map(tuple, ran.collect())) == collections.Counter(map(tuple, after.select(ran.columns).collect()))


def test_stages_leave_all_other_columns_alone(spark, edge, tmp_path):
    """Whatever the table's columns are called and hold, a kept row has its own values in them."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 600").limit(40).select("text").collect()
    names = ["_text", "assign", "access", "hex", "markov", "row", "mark", "mark2", "hits", "_hits", "whole", "in_hex", "often", "key", "at", "kept", "a.b"]
    rows = [(i, r.text + " password = hunter2hunter2", *(f"{n} {i}" for n in names)) for i, r in enumerate(prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.settle(stage(spark, docs, str(tmp_path)), name)
        got = after.collect()
        assert after.columns == docs.columns and got, name
        assert all(list(r)[2:] == [f"{n} {r.doc_id}" for n in names] for r in got), name
        docs = after
    assert all("hunter2" not in r.text for r in got)


def test_pipeline_with_nothing(spark, edge, tmp_path):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    benchmark.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, edge.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.settle(stage(spark, docs, str(tmp_path)), name)
        assert docs.filter("doc_id in (1, 2, 3)").count() == 0
