"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import brute_windows, classes, sentence
from voxlake.llm import mixing, sharding

random.seed(21)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it was for on are with they be at this have from or".split()
FR = "être à où çà élève même après déjà très français pâte côté août garçon là".split()


def prose(n, words):
    return " ".join(random.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = "file://" + str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(20, EN) + f" item{i} " + sentence(8)) for i in range(8)]
    rows = []
    for i in range(90):
        lang = "fr" if i % 3 == 0 else "en"
        text = prose(random.choice([5, 60, 150]), FR if lang == "fr" else EN) + f" n{i} " + sentence(random.choice([1, 30]))
        rows.append((i, text, lang, random.choice(["a", "a", "a", "b", "c"]), len(text)))
    for k in range(90, 110):
        old = rows[random.randrange(90)]
        w = old[1].split(" ")
        w[random.randrange(len(w))] = "edit"
        rows.append((k, " ".join(w) if k % 2 else old[1], old[2], random.choice("abc"), 0))
    rows += [(200, None, "en", "a", 0), (201, "", None, "b", 0), (202, "12 34 !!", "en", "c", 0), (203, items[2][1], "en", "b", 0), (204, prose(4, EN) + " " + items[3][1], "en", None, 0), (5, rows[5][1], "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    # language: what has no letters goes, all prose stays
    one = cp.identify(spark, docs, folder).cache()
    assert one.columns == names
    assert ids(one) == Counter(r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    # near-duplicates: the smallest id of each group, once
    two = cp.deduplicate(spark, one, folder).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    sets, root = classes(rows, cp.SHINGLE, cp.SIMILAR, 100)
    best = {}
    for (i, _), r in zip(rows, root):
        best[r] = min(i, best.get(r, i))
    assert two.columns == names and ids(two) == Counter(best.values())
    # benchmark passages
    three = cp.decontaminate(spark, two, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [x[0] for x in brute_windows([(r.doc_id, r.text) for r in two.collect()], items) if not x[2]]  # items have 13 words or more
    assert three.columns == names and ids(three) == Counter(clean) and 203 not in clean
    # mixing: whole epochs of each source, and the first documents in hash order for the rest
    four = cp.mix(spark, three, folder).cache()
    at = [(r.doc_id, r.source, r.h, len(re.findall(r"[^\x20\x09-\x0d]+", r.text))) for r in three.withColumn("h", mixing.draw_hash("doc_id", "text", 17)).collect()]
    tokens = defaultdict(int)
    for _, s, _, n in at:
        tokens[s] += n
    t = np.array([float(tokens[s]) for s in tokens])
    w = mixing.weights_at(t / t.sum(), mixing.find_exponent(t, max_repeats=cp.MAX_REPEATS))
    total = mixing.full_budget(t, w)
    want = Counter()
    for s, x, n in zip(tokens, w.tolist(), t.tolist()):
        whole = math.floor(x * total / n + 1e-9)
        left = math.floor((x * total / n - whole) * n + 1e-6)
        run = 0
        for i, _, _, k in sorted((y for y in at if y[1] == s), key=lambda y: y[2]):
            run += k
            want[i] += whole + (run <= left)
    assert four.columns == names and ids(four) == want and max(want.values()) <= 2 and min(want.values()) >= 1
    # shards: the key's jump hash, slots without gaps
    five = cp.shard(spark, four, folder)
    got = five.withColumn("key", F.xxhash64("doc_id")).collect()
    assert [r.shard for r in got] == sharding.jump_hash(np.array([r.key for r in got], np.int64).view(np.uint64), cp.SHARDS).tolist()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the whole
    whole = cp.run(spark, folder)
    assert ids(whole) == ids(five) and whole.columns == five.columns
    assert [n for n, _ in cp.STAGES] == ["language", "jaccard", "decontaminate", "mix", "shard"]


def test_empty_documents(spark, folder, tmp_path):
    to = "file://" + str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{to}/benchmark.parquet")
    assert cp.run(spark, to).count() == 0
