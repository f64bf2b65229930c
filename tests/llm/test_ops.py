"""Each operator against a brute-force version, with nulls, empty and repeated rows, ties and clashing names."""

import hashlib
import json
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetflow.llm import op1_ngram_join, op2_chat, op3_toxicity, op4_decontamination, op5_fingerprint, op6_mixing, op7_line_dedup, op8_substring, op9_warc, op10_url_filter, registry, wordhash, zipread
from sheetflow.llm.common import shared_dir, table
from sheetflow.llm.components import components

from ..helpers import SF, same

#: Columns that clash with the operators' own names.
EXTRA = ["id", "n", "code", "pivot", "a", "b", "label", "first", "size", "part", "key", "line", "slot", "text_", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, **columns):
    df = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


# 1: n-gram join


def shingle_set(t):
    w = word_list((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = [k for k in sorted(sets) if sets[k]]
    for i, x in enumerate(keys):
        for y in keys[:i]:
            inter = len(sets[x] & sets[y])
            if 100 * inter >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_join.join_documents(df).collect()}


def test_join_small_cases(spark):
    base = [f"w{k}" for k in range(40)]
    texts = [None, "", " \t", "One two", "one TWO", "one two three", " ".join(base), " ".join(base).upper(), " ".join([*base, "x"]), " ".join([*base, "x", "y", "z"]), " ".join(base[:20] + ["q"] + base[21:]), "É " + " ".join(base[:4]), "é " + " ".join(base[:4])]
    texts += [" ".join(base[k:] + [f"n{k}-{j}" for j in range(k)]) for k in range(1, 12)]
    assert joined(docs(spark, texts)) == brute_components(dict(enumerate(texts)))


def test_join_families_around_the_threshold(spark):
    """Many altered copies of few texts, so regions have members inside and outside the ball."""
    rng = np.random.default_rng(3)
    texts = []
    for f in range(3):
        base = [f"f{f}w{rng.integers(60)}" for _ in range(60)]
        for _ in range(40):
            w = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                w[at] = f"v{rng.integers(3)}"
            texts.append(" ".join(w))
    assert joined(docs(spark, texts)) == brute_components(dict(enumerate(texts)))


def test_join_counts_every_link(spark):
    """Links of two members of a ball and of copies count too."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base), "", "alone in the table with no link"]
    for _ in range(30):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = f"v{rng.integers(3)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    want = {i: sum(i != k and bool(y) and 5 * len(x & y) >= 4 * len(x | y) for k, y in enumerate(sets)) for i, x in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in op1_ngram_join.join_documents(docs(spark, texts)).collect()} == want


def brute_links(texts):
    sets = [shingle_set(t) for t in texts]
    return {i: sum(i != k and bool(y) and 5 * len(x & y) >= 4 * len(x | y) for k, y in enumerate(sets)) for i, x in enumerate(sets)}


@pytest.mark.parametrize("every", [True, False])
def test_join_splits_and_rings(spark, every):
    """Small blocks: regions split by new pivots, level by level, and dense ones meet block by block."""
    rng = np.random.default_rng(8)
    texts = []
    shared = [f"s{k}" for k in range(30)]
    for f in range(12):  # families that share a passage, so that one territory holds several
        base = [f"f{f}w{k}" for k in range(int(rng.integers(4, 40)))]
        for _ in range(int(rng.integers(2, 14))):
            w = shared + base
            for at in rng.integers(0, len(w), rng.integers(0, 4)):
                w[at] = f"v{rng.integers(3)}"
            texts.append(" ".join(w))
    j = op1_ngram_join.Join(block_docs=6, block_codes=600, sub_pivots=3, most_levels=3, most_rows=3.0, most_share=0.95)
    got = {r.doc_id: r for r in op1_ngram_join.join_documents(docs(spark, texts), j, every=every).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_components(dict(enumerate(texts)))
    if every:
        assert {k: r.n_links for k, r in got.items()} == brute_links(texts)


def test_join_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for at in rng.integers(0, 100, rng.integers(0, 4)):
            w[at] = f"v{rng.integers(40)}"
        texts.append(" ".join(w))
    sets, codes = [shingle_set(t) for t in texts], {}
    has = np.zeros((len(sets), len({c for s in sets for c in s})), np.float32)
    for i, s in enumerate(sets):
        for c in s:
            has[i, codes.setdefault(c, len(codes))] = 1
    inter, n = has @ has.T, has.sum(1)
    link = (5 * inter >= 4 * (n[:, None] + n[None, :] - inter)) & ~np.eye(len(n), dtype=bool)
    got = {r.doc_id: r for r in op1_ngram_join.join_documents(docs(spark, texts)).collect()}
    assert {k: r.n_links for k, r in got.items()} == dict(enumerate(link.sum(1).tolist()))
    label = np.arange(len(n))
    for _ in range(50):
        label = np.minimum(label, np.where(link, label[None, :], len(n)).min(1))
    assert {k: r.component_id for k, r in got.items()} == dict(enumerate(label.tolist()))
    part = {r.doc_id: r.component_id for r in op1_ngram_join.join_documents(docs(spark, texts), every=False).collect()}
    assert part == dict(enumerate(label.tolist()))


def test_join_takes_one_python_process_a_task(spark, monkeypatch):
    """No stage chains two Python operators: each holds a process of its own, for every task of an executor."""
    plans, plain = [], op1_ngram_join.stored

    def stored(df, where):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, where)

    monkeypatch.setattr(op1_ngram_join, "stored", stored)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(base[:30]), "nothing like the others here at all", None]
    assert joined(docs(spark, texts)) == brute_components(dict(enumerate(texts)))
    stages = [part for plan in plans for part in re.split(r"Exchange|Scan", plan)]
    assert any("MapInArrow" in part for part in stages) and max(part.count("MapInArrow") for part in stages) == 1


def test_join_null_and_repeated_identifiers(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (2, t + " x"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in op1_ngram_join.join_documents(df).collect() if r.doc_id is not None)
    assert got == [(True, 2, 27, 2, 2), (True, 4, 26, 2, 2), (True, 4, 26, 2, 2), (True, 7, 0, 7, 0)]
    rest = [(r.n_shingles, r.component_id, r.n_links) for r in op1_ngram_join.join_documents(df).collect() if r.doc_id is None]
    assert sorted(rest) == [(0, None, 0), (26, None, 0)]
    kept = op1_ngram_join.near_duplicate_stage(spark, df.withColumn("gone", F.lit(1)).withColumn("GONE_", F.lit(2)), None)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 2, 7] and kept.columns == ["doc_id", "text", "gone", "GONE_"]


def test_join_test_table(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_join.op1_ngram_join(spark, SF).collect()}
    assert got == brute_components(rows)


def test_join_empty_table(spark):
    assert joined(docs(spark, ["a"]).limit(0)) == {}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(links, shared_dir(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 2: chat formatting


def test_tool_calls(spark):
    schema = {"find": {"type": "object", "properties": {"q": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"], "additionalProperties": False}}
    calls = spark.createDataFrame([
        ("c", "1", 5, "find", '{"q": "ab", "n": 2}'), ("c", "1", 7, "find", '{"q":"late"}'), ("c", "2", 1, "find", '{"n": 1}'), ("c", "3", 2, "find", '{"q": "x"}'), ("c", "4", 3, "find", '{"q": "ab", "z": 1}'),
        ("c", "5", 4, "other", "{}"), ("c", None, 4, "find", None), ("d", "1", 1, "find", "[1]"), ("d", "2", 1, "find", '{"q": "ab", "n": "2"}'),
    ], "conv_id string, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([("c", "1", 2, "early \"x\"\n"), ("c", "9", 2, None), ("c", None, 2, "x")], "conv_id string, call_id string, turn long, content string")
    rows = op2_chat.link(calls, results, schema).collect()
    got = {(r.conv_id, r.call_id, r.turn, r.kind): (r.status, r.problem, r.after_turn) for r in rows}
    assert got[("c", "1", 5, "call")] == ("linked", None, 5) and got[("c", "1", 7, "call")] == ("duplicate", None, 7)
    assert got[("c", "1", 2, "result")] == ("linked", None, 5)  # after its call
    assert got[("c", "2", 1, "call")] == ("pending", "q is missing", 1) and got[("c", "3", 2, "call")][1] == "q breaks minLength" and got[("c", "4", 3, "call")][1] == "unknown property"
    assert got[("c", "5", 4, "call")][1] == "unknown tool" and got[("c", None, 4, "call")] == ("pending", "no object", 4)
    assert got[("d", "1", 1, "call")][1] == "no object" and got[("d", "2", 1, "call")][1] == "n is no integer"
    assert got[("c", "9", 2, "result")][0] == "orphan" and got[("c", None, 2, "result")][0] == "orphan"
    for r in rows:
        again = json.dumps(json.loads(r.json), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.json == again
    assert op2_chat.link(calls.limit(0), results.limit(0), schema).count() == 0


def test_tool_calls_in_topological_order(spark):
    """Chains, a missing need, a circle and what hangs on it, several tools, broken arguments, repeated rows, other columns."""
    schema = {"t": {"type": "object", "properties": {"x": {"type": "string", "enum": ["a"]}, "y": {"type": "string", "pattern": "^b"}}}}
    chain = [("c", f"k{i}", 20 - i, "t", '{"x":"a"}', f"k{i - 1}" if i else None) for i in range(11)]
    more = [("c", "m", 1, "t", '{"x":"z"}', "nobody"), ("c", "o1", 1, "t", '{"y":"c"}', "o2"), ("c", "o2", 1, "t", "{", "o1"), ("c", "o3", 1, "u", "{}", "o1"), ("d", "k0", 1, "t", "{}", None), ("d", "k0", 1, "t", "{}", None)]
    calls = spark.createDataFrame(chain + more, "conv_id string, call_id string, turn long, name string, arguments string, needs string").withColumn("level", F.lit(1)).withColumn("step", F.lit(2))
    results = spark.createDataFrame([("c", "k3", 1, "r"), ("c", "o1", 1, "r"), ("c", "k3", 1, "r")], "conv_id string, call_id string, turn long, content string").withColumn("status", F.lit("x"))
    rows = op2_chat.link(calls, results, schema).collect()
    got = {(r.conv_id, r.call_id, r.kind): r for r in rows}
    assert [got["c", f"k{i}", "call"].step for i in range(11)] == [2 * i for i in range(11)] and got["c", "k3", "result"].step == 7
    assert got["c", "m", "call"].step == 0 and got["c", "m", "call"].problem == "x breaks enum" and got["c", "o1", "call"].problem == "y breaks pattern"
    assert all(got["c", k, "call"].status == "cyclic" and got["c", k, "call"].step is None for k in ("o1", "o2", "o3")) and got["c", "o1", "result"].status == "cyclic"
    assert json.loads(got["c", "o2", "call"].json)["arguments"] == "{" and got["c", "o2", "call"].problem == "no object"
    assert len([r for r in rows if r.conv_id == "d"]) == 2 and len([r for r in rows if r.kind == "result"]) == 3
    with pytest.raises(ValueError, match="oneOf"):
        op2_chat.link(calls, results, {"t": {"type": "object", "oneOf": []}})


# 3: toxicity


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        sentences = [" ".join(f"w{rng.integers(200)}" for _ in range(8)) for _ in range(rng.integers(2, 7))]
        if k % 5 == 0:
            at = rng.integers(len(sentences))
            sentences[at] += f" grobian{'abc'[rng.integers(3)]}"
        rows.append((k, ". ".join(sentences) + ".", int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic", F.lit(1).alias("quality"))


def test_toxicity_held_out(spark):
    d, labels = toxic_corpus(spark)
    model = op3_toxicity.train(d, labels)
    got = {r.doc_id: r for r in op3_toxicity.score(d.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "...")], d.schema)), model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k].score >= 0.3) == (k % 5 == 0) for k in held)
    assert right >= 0.97 * len(held)
    texts = {r.doc_id: r.text for r in d.collect()}
    for k in held:
        for s in got[k].offending if k % 5 == 0 else []:
            assert "grobian" in texts[k][s.start : s.end]
    assert all(got[k].score == 0.0 for k in (-1, -2, -3)) and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    d, labels = toxic_corpus(spark, 20)
    for known in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert op3_toxicity.score(d, op3_toxicity.train(d, known)).count() == 20
    assert op3_toxicity.score(d.limit(0), op3_toxicity.train(d, labels)).count() == 0


def test_toxicity_query_columns(spark):
    out = op3_toxicity.op3_toxicity(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == table(spark, SF, "documents").count()
    assert {r.doc_id: r.held_out for r in out.collect()} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(out.count())}


def plain_score(text, model):
    """Noisy-or over the sentences of one text, word by word."""
    s, data = model.settings, (text or "").encode().lower() if (text or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    m64, sentences, start = (1 << 64) - 1, [[]], None
    code = [int(c) for c in wordhash._codes]

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    def feature(word, kind):
        h = sum(code[c] * pow(wordhash.BASE, i, 1 << 64) for i, c in enumerate(word)) + kind + 1
        return mixed(h & m64) >> 64 - s.bits

    for at, c in enumerate(data + b" "):
        solid = c >= 128 or chr(c).isalnum()
        if solid and start is None:
            start = at
        elif not solid and start is not None:
            word, start = data[start:at], None
            sentences[-1] += [feature(word, 0)] + [feature(word[:n], k) for k, n in enumerate(s.prefixes, 1)]
        if c in b"\n\r!.?":
            sentences.append([])
    clean = 1.0
    for ids in sentences:
        if ids:
            x = sum(float(model.weights[i]) for i in ids) + model.bias
            clean *= 1 - 1 / (1 + np.exp(-x))
    return 1 - clean


def test_toxicity_against_plain_scores(spark):
    """Every row of the test table, recomputed from the weights; and the fold that is held out."""
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = op3_toxicity.train(d, labels)
    got = {r.doc_id: r for r in op3_toxicity.op3_toxicity(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert abs(got[k].score - plain_score(t, model)) < 1e-6 and got[k].predicted == int(got[k].score >= 0.3)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)


def test_toxicity_learns_from_the_other_folds_alone(spark):
    """Labels of the held-out fold change no weight; repeated rows and columns of any names are carried along."""
    d, labels = toxic_corpus(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    a = op3_toxicity.train(d, labels)
    b = op3_toxicity.train(d.withColumn("score", F.lit(1)), labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (a.weights == b.weights).all() and a.bias == b.bias
    twice = op3_toxicity.score(d.union(d), a).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert twice.filter("n <> 1 or rows <> 2").count() == 0


# 4: decontamination


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1]))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    letters = list("abcd ")
    items = ["".join(rng.choice(letters, rng.integers(3, 50))) for _ in range(6)] + ["", None, "  "]
    texts = [None, ""]
    for _ in range(60):
        e = list(op4_decontamination.plain(items[rng.integers(6)]))
        for _ in range(rng.integers(0, 6)):
            if e:
                e[rng.integers(len(e))] = str(rng.choice(letters))
        texts.append("".join(rng.choice(letters, 30)) + "".join(e) + "".join(rng.choice(letters, 30)))
    budget = op4_decontamination.Budget(error_rate=0.15, block_chars=60)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in op4_decontamination.find_leaks(docs(spark, texts), bench, budget).collect())
    plain = op4_decontamination.plain
    want = sorted((d, i, k) for d, t in enumerate(texts) for i, x in enumerate(items) if plain(x) and plain(t) for k in [brute_distance(f" {plain(x)} ", f" {plain(t)} ")] if k <= int(0.15 * len(plain(x))))
    assert got == want and len(got) > 20
    kept = {r.doc_id for r in op4_decontamination.drop_leaks(docs(spark, texts), bench, budget).collect()}
    assert kept == set(range(len(texts))) - {d for d, _, _ in want}
    assert op4_decontamination.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_leaks_on_the_test_table(spark):
    """Every document and item, against a plain edit distance wherever a piece of the item could make a hit."""
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    plain, want = op4_decontamination.plain, set()
    coded = {i: f" {plain(x)} " for i, x in items.items() if plain(x)}
    for d, t in rows.items():
        text = f" {plain(t)} "
        for i, x in coded.items():
            k = (len(x) - 2) // 10
            # one of k + 1 pieces is unchanged (pigeonhole): without any, the distance is above k
            if any(x[len(x) * p // (k + 1) : len(x) * (p + 1) // (k + 1)] in text for p in range(k + 1)) and op4_decontamination.best_match(x, text, k) is not None:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in op4_decontamination.op4_decontamination(spark, SF).collect()}
    assert got == want and got


def test_leaks_identifiers_and_words(spark):
    bench = spark.createDataFrame([("a", "cat"), (None, "dog"), ("b", "cat")], "item_id string, text string")
    d = spark.createDataFrame([(1, "concatenation"), (2, "a CAT, dog"), (None, "cat"), (2, "a CAT, dog")], "doc_id int, text string").withColumn("item_id", F.lit(0)).withColumn("distance", F.lit(0))
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in op4_decontamination.find_leaks(d, bench).collect())
    assert got == sorted([("2", "a", 0), ("2", "None", 0), ("2", "b", 0)] * 2 + [("None", "a", 0), ("None", "b", 0)])
    assert [r.doc_id for r in op4_decontamination.drop_leaks(d, bench).collect()] == [1]


# 5: fingerprints


def parts(t):
    return {p for p in re.split(rb"[\n\r.!?]+", (t or "").encode()) if p}


def likeness(a, b):
    return len(parts(a) & parts(b)) / len(parts(a) | parts(b)) if parts(a) | parts(b) else 1.0


def check_fingerprints(rows, texts):
    order = sorted(texts)
    assert sorted(r.doc_id for r in rows) == order
    got = {r.doc_id: r for r in rows}
    for k, d in enumerate(order):
        t, f = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        e = op5_fingerprint.edited(t, f)
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[d].near_edited - likeness(t, e)) < 1e-9 and abs(got[d].near_next - likeness(t, f)) < 1e-9
    return got


def test_fingerprints(spark):
    texts = [None, "", "a", "a", "One. Two. Three.\nFour", ". ".join(f"é{k}" for k in range(400)), "One. Two. Three.\nFour", "..."]
    got = check_fingerprints(op5_fingerprint.fingerprint_documents(docs(spark, texts)).collect(), dict(enumerate(texts)))
    assert got[2].fingerprint == got[3].fingerprint and got[4].fingerprint == got[6].fingerprint != got[5].fingerprint and got[0].fingerprint == got[1].fingerprint


def test_fingerprints_of_the_test_table(spark):
    check_fingerprints(op5_fingerprint.op5_fingerprint(spark, SF).collect(), {r.doc_id: r.text for r in table(spark, SF, "documents").collect()})


def test_fingerprints_of_one_and_no_rows(spark):
    one = op5_fingerprint.fingerprint_documents(docs(spark, ["ab. cd"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op5_fingerprint.fingerprint_documents(docs(spark, ["a"]).limit(0)).count() == 0


def test_repeated_identifiers_have_neighbours(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (None, "n")], "doc_id long, text string")
    assert op5_fingerprint.fingerprint_documents(df).count() == 5


# 6: mixing


def test_targets():
    assert op6_mixing.targets([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    assert op6_mixing.targets([1, 99, 0], [1, 1, 5], 3) == [3, 97, 0]
    assert op6_mixing.targets([0, 0], [1, 2], 3) == [0, 0] and op6_mixing.targets([], [], 3) == []


def test_split_tree_is_exact():
    quota = np.array([50, 7, 0, 900])
    out = op6_mixing.split_tree(quota, 7, np.random.default_rng(0))
    assert (out.sum(0) == quota).all() and out.sum(1).max() - out.sum(1).min() <= 3


@pytest.mark.parametrize("texts", [[f"{'w ' * (k % 50)}" for k in range(900)], [None, "", "a b c"], [None, ""], []])
def test_mix(spark, texts):
    df = docs(spark, texts or ["a"]).limit(len(texts)).withColumn("source", F.expr("CASE WHEN doc_id % 4 = 3 THEN NULL ELSE source END"))
    rows = op6_mixing.mix(df).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows)) == sorted(map(tuple, op6_mixing.mix(df).collect()))
    by = {}
    for r in rows:
        assert r.size == len(word_list(texts[r.doc_id])) and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        assert len([x for x in r.shards.split(",") if x]) == r.copies
        by.setdefault(None if r.doc_id % 4 == 3 else f"s{r.doc_id % 3}", []).append(r)
    names = sorted(k for k in by if k) + ([None] if None in by else [])
    sizes = [sum(r.size for r in by[k]) for k in names]
    for k, want in zip(names, op6_mixing.targets(sizes, [1 + i % 3 for i in range(len(names))], 3), strict=True):
        assert all(abs(r.target - want) < 1e-6 for r in by[k]) and want - 50 <= sum(r.taken for r in by[k]) <= want + 1e-6


def brute_targets(sizes, weights, cap):
    """Water filling: the level at which shares, cut at cap times their size, use up the total."""
    lo, hi = 0.0, 2 * float(sum(sizes)) * max(weights, default=1)
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(cap * n, level * w) for n, w in zip(sizes, weights, strict=True)) < sum(sizes) else (lo, level)
    return [min(cap * n, hi * w) for n, w in zip(sizes, weights, strict=True)]


def check_mix(rows, texts, sources, slack):
    """Sizes, targets and what is taken of each source, recomputed; every draw is in one shard."""
    names = sorted({v for v in sources.values() if v is not None}) + ([None] if None in sources.values() else [])
    sizes = {n: sum(len(word_list(texts[d])) for d in texts if sources[d] == n) for n in names}
    want = dict(zip(names, brute_targets(list(sizes.values()), [1 + i % 3 for i in range(len(names))], 3), strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(word_list(texts[r.doc_id])) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-3
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * (r.copies + r.part_copy)
        assert len([x for x in r.draws.split(",") if x]) == r.copies + r.part_copy
        taken[s] += r.taken
    for n in names:
        longest = max(len(word_list(texts[d])) for d in texts if sources[d] == n)
        assert want[n] - longest - slack <= taken[n] <= want[n] + 1e-6
    places = [x for r in rows for x in r.draws.split(",") if x]
    assert len(places) == len(set(places))


def test_mix_of_the_test_table(spark):
    rows = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    got = op6_mixing.op6_mixing(spark, SF).collect()
    check_mix(got, {k: r.text for k, r in rows.items()}, {k: r.source for k, r in rows.items()}, 0)
    assert sorted(map(repr, got)) == sorted(map(repr, op6_mixing.op6_mixing(spark, SF).collect()))


def test_mix_with_repeated_and_null_identifiers(spark):
    """An identifier in several sources is a document of each; within a source rows of one identifier go together."""
    rng = np.random.default_rng(12)
    rows = [(None if d == 7 else d, "w " * int(rng.integers(1, 90)), s) for s in "abc" for d in range(200)] + [(3, "w " * 10, "a"), (3, "w " * 10, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op6_mixing.mix(df).collect()
    want = brute_targets([sum(t.count("w") for _, t, s in rows if s == x) for x in "abc"], [1, 2, 3], 3)
    assert len(got) == len(rows)
    for x, target in zip("abc", want, strict=True):
        assert target - 120 <= sum(r.taken for r in got if r.source == x) <= target + 1e-6
    assert all(r.taken <= 3 * r.size for r in got) and len({(r.copies, r.part_copy) for r in got if r.doc_id == 3 and r.source == "a"}) == 1


def test_every_draw_has_a_place(spark):
    mixed = op6_mixing.mix(docs(spark, ["w " * (k % 50) for k in range(120)])).cache()
    rows = op6_mixing.draws(mixed, ranges=4).collect()
    taken, shards = {}, {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.size
        shards.setdefault(r.shard, []).append(r.position)
    assert all(taken.get(r.doc_id, 0) == r.taken and len([x for x in rows if x.doc_id == r.doc_id]) == r.copies + r.part_copy for r in mixed.collect())
    assert any(r.part_copy for r in mixed.collect()) and all(sorted(v) == list(range(len(v))) for v in shards.values())


# 7: line dedup


def most_edits(a, b, p):
    return min(p.most, (min(len(a), len(b)) + p.per_chars // 2) // p.per_chars)


def brute_lines(texts, p):
    first = {}
    for d, t in sorted(texts.items()):
        for n, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (d, n))
    late = set()
    for a in first:
        for b in first:
            k = most_edits(a, b, p)
            if first[a] < first[b] and abs(len(a) - len(b)) <= k and within(a, b, k):
                late.add(b)
    out = {}
    for d, t in texts.items():
        keep = [line for n, line in enumerate(t.split("\n")) if not line.strip(" ") or (line.strip(" ") not in late and first[line.strip(" ")] == (d, n))] if t is not None else None
        out[d] = None if keep is None else "\n".join(keep)
    return out


def within(a, b, k):
    """Edit distance in a band, plainly."""
    row = {j: j for j in range(min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            best = min(row.get(j, k + 1), new.get(j - 1, k + 1)) + 1
            if j:
                best = min(best, row.get(j - 1, k + 1) + (x != b[j - 1]))
            new[j] = best
        row = new
    return row.get(len(b), k + 1) <= k


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


LINES = op7_line_dedup.Lines


@pytest.mark.parametrize("p", [LINES(), LINES(most_pairs=2, block=3), LINES(per_chars=6, most=7, bit_parallel=True), LINES(per_chars=7, most=6, most_pairs=3, block=2), op7_line_dedup.STAGE])
def test_lines_against_brute_force(spark, p):
    rng = np.random.default_rng(2)
    bases = ["".join(rng.choice(list("abcdé "), rng.integers(8, 40))) for _ in range(6)] + ["short", "page 1 of twenty-five", "page 2 of twenty-five", "page 13 of twenty-five"]
    bases += ["".join(rng.choice(list("abcdefgh "), n)).strip() for n in (9, 12, 19, 23, 47, 50, 61, 91, 97, 104, 131)]
    texts = [None, "", "\n\n", " padded line of some length ", "padded line of some length"]
    for _ in range(60):
        lines = []
        for _ in range(rng.integers(1, 6)):
            e = list(bases[rng.integers(len(bases))])
            for _ in range(rng.integers(0, 7)):
                at = rng.integers(len(e)) if e else 0
                e[at : at + rng.integers(0, 2)] = [str(rng.choice(list("abxy"))) for _ in range(rng.integers(0, 2))]
            lines.append("".join(e))
        texts.append("\n".join(lines))
    want = brute_lines(dict(enumerate(texts)), p)
    got = {r.doc_id: r for r in op7_line_dedup.dedup_lines(docs(spark, texts), p).collect()}
    assert {k: r.text for k, r in got.items()} == want
    for k, r in got.items():
        assert r.n_lines == (0 if texts[k] is None else texts[k].count("\n") + 1)
    assert op7_line_dedup.dedup_lines(docs(spark, texts).limit(0), p).count() == 0


def test_lines_edge_cases(spark):
    t = "a line that is long enough"
    df = spark.createDataFrame([(1, t + "\n" + t), (1, t + "\n" + t), (None, t), (2, "x" * 20_000 + "\n" + t + "\nkept"), (3, None)], "doc_id long, text string")
    df = df.withColumn("n_lines", F.lit("mine")).withColumn("gone_doc", F.lit("own"))
    got = op7_line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "gone_doc", "n_lines_", "n_removed"]
    assert sorted((str(r.doc_id), r.text, r["n_lines_"], r.n_removed) for r in got.collect() if r.text is not None and len(r.text) < 100) == [("1", t, 2, 1), ("1", t, 2, 1), ("None", t, 1, 0)]
    assert [(r["n_lines_"], r.n_removed, r.text) for r in got.filter("doc_id = 2").collect()] == [(3, 1, "x" * 20_000 + "\nkept")]
    with pytest.raises(ValueError):
        op7_line_dedup.Lines(most=9)


def test_bit_parallel_distance(spark):
    """Against Spark's own: whole texts, and lines that are cut to their differing middles."""
    rng = np.random.default_rng(21)
    rows = [("a", "b"), ("a", "a"), ("é", "éé"), ("x" * 62, "y" * 62), ("ab" * 31, "ba" * 31)]
    for _ in range(200):
        a = list(rng.choice(list("abé"), rng.integers(1, 63)))
        b = [str(c) for c in a if rng.random() > 0.1] + list(rng.choice(list("abx"), rng.integers(1, 4)))
        rows.append(("".join(a), "".join(b)[:62]))
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.filter(op7_line_dedup.bit_parallel(F.col("x"), F.col("y")) != F.levenshtein("x", "y")).count() == 0
    lines = df.select(F.concat(F.lit("start "), "x", F.lit(" the end")).alias("a_line"), F.concat(F.lit("start "), "y", F.lit(" the end")).alias("b_line"))
    for p in (LINES(bit_parallel=True), LINES(most=5, bit_parallel=True), LINES()):
        near = lines.filter(F.call_function("levenshtein", F.col("a_line"), F.col("b_line"), p.edits(F.least(F.length("a_line"), F.length("b_line")))) >= 0)
        assert sorted(map(tuple, op7_line_dedup.verified(lines, p).collect())) == sorted(map(tuple, near.collect()))


def test_lines_of_one_shape(spark):
    """A group far above ``most_pairs``: blocks meet, no line is left out."""
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh "), 120)).strip()
    texts = []
    for _ in range(400):
        e = list(base)
        for at in rng.integers(0, len(e), rng.integers(1, 5)):
            e[at] = str(rng.choice(list("xyz")))
        texts.append("".join(e))
    p = LINES(most=3, block=32)
    got = {r.doc_id: r.text for r in op7_line_dedup.dedup_lines(docs(spark, texts), p).collect()}
    assert got == brute_lines(dict(enumerate(texts)), p)


def test_line_stage_takes_a_changed_word(spark):
    line = "the quick brown fox jumps over the lazy dog while seven other animals look on from the far side of the river"
    two = op7_line_dedup.line_dedup_stage(spark, docs(spark, [line, line.replace("quick", "rapid")]).withColumn("n_chars", F.lit(0)), SF)
    assert {r.doc_id: r.text for r in two.collect()} == {0: line, 1: ""}


# 8: substring dedup


def brute_windows(texts):
    first, out = {}, {}
    for d, t in sorted(texts.items()):
        w = (t or "").encode().split()
        covered = [False] * len(w)
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(windows):
            if first.get(x, d) < d:
                covered[i : i + 50] = [True] * 50
        for x in windows:
            first.setdefault(x, d)
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[d] = (len(w), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_windows_against_brute_force(spark, batches):
    rng = np.random.default_rng(4)
    passages = [[f"p{k}w{rng.integers(30)}" for _ in range(rng.integers(45, 140))] for k in range(5)] + [["x"] * 120]
    texts = [None, "", "a\tb\n c"]
    for _ in range(40):
        w = [f"u{rng.integers(9)}" for _ in range(rng.integers(0, 80))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            lo = rng.integers(0, 20)
            w += p[lo : lo + rng.integers(40, 140)] + [f"t{rng.integers(1000)}"]
        texts.append(" ".join(w))
    texts += texts[-3:]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op8_substring.remove_repeats(docs(spark, texts), batches).collect()}
    assert got == brute_windows(dict(enumerate(texts)))


def test_windows_of_the_test_table_and_of_none(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op8_substring.op8_substring_dedup(spark, SF).collect()}
    assert got == brute_windows({r.doc_id: r.text for r in table(spark, SF, "documents").collect()})
    assert op8_substring.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


def test_window_index_is_opened_again(spark):
    """Batches added by two processes: the second finds what the first indexed, and runs are compacted level by level."""
    rng = np.random.default_rng(14)
    passage = [f"p{k}" for k in range(90)]
    texts = {}
    for k in range(24):
        w = [f"u{rng.integers(1000)}" for _ in range(20)] + (passage[rng.integers(0, 20) :] if k % 2 else []) + [f"t{rng.integers(1000)}"]
        texts[k] = " ".join(w)
    where, covered = shared_dir(spark), {}
    for k in range(6):
        index = op8_substring.WindowIndex(spark, where, fanout=2)
        assert index.batches == k
        batch = spark.createDataFrame([(d, texts[d]) for d in range(4 * k, 4 * k + 4)], "doc_id long, text string")
        history = spark.createDataFrame([(d, texts[d]) for d in range(4 * k)], "doc_id long, text string")
        for r in index.add(batch, history, 4 * k - 1).collect():
            covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert sorted(level for _, level, _ in index.runs) == [1, 2]
    assert {d: len(covered.get(d, ())) for d in texts} == {d: n for d, (_, n, _) in brute_windows(texts).items()}


def test_window_index_joins_history_in_place(spark):
    """A batch is joined with the buckets of history as they lie, and its run has one file for each bucket."""
    rng = np.random.default_rng(15)
    texts = [" ".join(f"u{rng.integers(1000)}" for _ in range(400)) for _ in range(20)]
    first, second = docs(spark, texts[:10]), docs(spark, texts[5:]).filter("doc_id > 9")
    index = op8_substring.WindowIndex(spark, shared_dir(spark), buckets=8)
    index.add(first)
    with op8_substring.in_place(spark):
        plan = index._merged(op8_substring.scan(second))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # of the batch alone
    index.add(second, first, 9)
    assert [len(run.inputFiles()) for _, _, run in index.runs] == [8, 8]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_windows_with_null_and_repeated_identifiers(spark):
    t = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t), (None, None)], "doc_id long, text string").withColumn("anchor", F.lit(1)).withColumn("n_words", F.lit(2))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in op8_substring.remove_repeats(df, 2).collect())
    assert got == [("4", 60, 0), ("4", 60, 0), ("9", 60, 60), ("None", 0, 0), ("None", 60, 0)]


# 9: WARC packages


def test_packages(spark):
    big = "<p>" + "é" * 100
    pages = spark.createDataFrame([(5, "http://a/", big), (3, None, big), (9, "x\r\nEvil: 1", big), (4, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small")], "page_id long, url string, html string")
    where = shared_dir(spark)
    manifest = op9_warc.write_packages(pages.withColumn("id", F.lit(1)), where, package_records=2)
    rows = {r.page_id: r for r in op9_warc.read_packages(manifest, where).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), **dict.fromkeys((4, 6, 7, 8), ("response", None))}
    assert all(r.payload_bytes == 203 and r.payload_digest == hashlib.sha256(big.encode()).hexdigest() for k, r in rows.items() if k in (3, 5, 9))
    assert rows[4].payload_bytes == 0 and all(r.payload_ok for r in rows.values())
    empty = shared_dir(spark)
    assert op9_warc.read_packages(op9_warc.write_packages(pages.limit(0), empty), empty).count() == 0


def test_warc_null_and_repeated_identifiers(spark):
    a, b = "a" * 200, "b" * 200
    pages = spark.createDataFrame([(5, "u", a), (7, "u", a), (7, "u", b), (None, "u", a), (None, None, None), (3, "u", b), (3, "u", b)], "page_id long, url string, html string")
    where = shared_dir(spark)
    rows = op9_warc.read_packages(op9_warc.write_packages(pages, where, package_records=3), where).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((str(r.page_id), r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == sorted([("5", sha(a), "response", None), ("7", sha(a), "revisit", 5), ("7", sha(b), "revisit", 3), ("None", sha(a), "response", None), ("None", sha(""), "response", None), *[("3", sha(b), "response", None)] * 2])
    assert all(r.payload_ok for r in rows)


def test_zip64_directory(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(70_000):  # more entries than the old directory can count
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"%d" % k)
    data = path.read_bytes()
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    found = zipread.members(read, len(data))
    assert len(found) == 70_000
    m = found[66_000]
    at = zipread.data_offset(read, m)
    assert read(at, m.size) == b"66000" and sum(asked) < len(data)
    with pytest.raises(zipread.BadPackage):
        zipread.members(lambda at, n: b"no zip"[at : at + n], 6)


# 10: URL filters


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://a.example.com/en", "http://b.net/es/?q", "http://net/fr/", "http://x.org/porn", "http://x.org/pornography", "http://x.org/free-win?bet=1", "http://x.org/free-free", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in op10_url_filter.judge_urls(pages, op10_url_filter.RULES).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
        ("a.example.com", "/en", "com/", "allow"), ("b.net", "/es/", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("x.org", "/porn", None, "block"), ("x.org", "/pornography", None, "allow"),
        ("x.org", "/free-win", None, "block"), ("x.org", "/free-free", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert op10_url_filter.judge_urls(pages.limit(0), op10_url_filter.RULES).count() == 0


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line dedup", "n-gram join", "decontamination", "mixing"]
    scores = {r.doc_id: r.score for r in op3_toxicity.op3_toxicity(spark, SF).collect()}
    one = steps["toxicity"](spark, d, SF)
    assert one.columns == d.columns and {r.doc_id for r in one.collect()} == {k for k, s in scores.items() if s < 0.3}
    small = one.filter("doc_id < 60").cache()
    two = steps["line dedup"](spark, small, SF)
    assert two.columns == d.columns and {r.doc_id: r.text for r in two.collect()} == brute_lines({r.doc_id: r.text for r in small.collect()}, op7_line_dedup.STAGE)
    three = steps["n-gram join"](spark, d, SF)
    assert {r.doc_id for r in three.collect()} == {k for k, (_, c) in brute_components({r.doc_id: r.text for r in d.collect()}).items() if k == c}
    leaks = {r.doc_id for r in op4_decontamination.op4_decontamination(spark, SF).collect()}
    four = steps["decontamination"](spark, d, SF)
    assert four.columns == d.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in d.collect()} - leaks
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "size", "source_size", "target", "taken"} and 0 < out.count() <= one.count()


def test_pipeline_stages_on_odd_tables(spark):
    """Null, empty and repeated rows, no rows at all, and columns named like the operators' own."""
    import corpus_pipeline

    t = "a text of several words that says nothing much at all, twice over"
    rows = [(1, t, "en", "s", 5), (1, t, "en", "s", 5), (None, t, None, None, None), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "   ", "en", "s", 3)]
    names = ["score", "offending", "n_sentences", "gone", "n_lines", "n_removed", "__gone", "copies", "component_id", "id", "c0", "first", "taken"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        out = stage(spark, df, SF)
        if name != "mixing":
            assert out.columns == df.columns
        assert {r.doc_id for r in out.collect()} >= {2, 3, 4, None}
