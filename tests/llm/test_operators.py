"""Operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from voxlake.llm import chat, decontaminate, language_id, line_dedup, mixing, ngram_jaccard, quality, sharding, token_files, topk
from voxlake.llm import queries as op_queries

random.seed(11)
WORDS = ["the", "of", "Éa", "x1", "don't", "日本", "run,", "ab", "zz", "Q", "wörd", "k9", "to", "be", "or", "not"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, shard int, id string"


def sentence(n):
    return " ".join(random.choice(WORDS) + str(random.randrange(40)) for _ in range(n))


def corpus():
    rows, base = [], [sentence(random.choice([1, 2, 3, 40, 120, 400])) for _ in range(30)]
    for t in base + random.choices(base, k=20):
        w = t.split(" ")
        if random.random() < 0.5 and len(w) > 20:
            for _ in range(random.choice([1, 1, 2, 5])):
                w[random.randrange(len(w))] = random.choice(WORDS)
        rows.append(" ".join(w))
    rows += [None, "", " \n\t ", "one", "one", "\n".join(base[:5]), base[3].upper(), "long " * 30000]
    out = [(i, t, random.choice(["en", "de", None]), random.choice(["a", "a", "b", None]), 0, "x", 1, "y") for i, t in enumerate(rows)]
    return out + [(5, rows[5], "en", "a", 0, "x", 1, "y"), (None, base[0], "en", "b", 0, "x", 1, "y"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    """(rows' sets, root of each row) by all pairs."""
    s, par = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and den * n >= num * len(s[i] | s[j]):
                par[find(i)] = find(j)
    return s, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(docs, k, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    s, root = classes(rows, k, num, 100)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    want = sorted(((i, len(x), min(least[r]) if x and least[r] else i) for (i, _), x, r in zip(rows, s, root)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_components(docs, k, num, 100).collect()), key=str)
    assert got == want


def test_jaccard_chain_of_near_copies(spark):
    """Many sets around the threshold: neighbours in the chain link, ends don't."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        base = list(base)
        base[(i * 7) % 200] = f"n{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = classes(rows, 3, 90, 100)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard_components(df).collect()}
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(60) for j in range(60))


def test_jaccard_counts_every_link(spark, tmp_path):
    """Members of one group, equal texts and rows without an id among them, against all pairs."""
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(30):
        w = list(base)
        w[(i * 31) % 150] = f"n{i}"
        if i % 3 == 0:
            w[(i * 17 + 5) % 150] = "m"
        rows.append((i, " ".join(w)))
    rows += [(40, rows[2][1]), (41, rows[2][1].replace(" ", "  ")), (42, None), (43, "one two"), (44, "one two"), (None, rows[3][1]), (45, " "), (46, "alone in the world")]
    to = "file://" + str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{to}/documents.parquet")
    s = [shingles(t, 3) for _, t in rows]
    want = [(i, sum(1 for q, y in enumerate(s) if q != p and x and y and 100 * len(x & y) >= 90 * len(x | y))) for p, ((i, _), x) in enumerate(zip(rows, s))]
    got = [(r.doc_id, r.n_links) for r in op_queries.QUERIES["op3_ngram_links"](spark, to).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(n for _, n in want) > 20


def test_one_of_each_stays(spark, docs):
    """Among the rows one id with three texts, two of them in one group, and rows without an id."""
    extra = [(5, "a text of its own under an id that others have " + sentence(30)), (5, rows_text(docs, 6)), (None, "no id and no copy " + sentence(30)), (None, rows_text(docs, 9))]
    full = docs.unionByName(spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in extra], SCHEMA)).cache()
    from pyspark.sql import functions as F

    kept = ngram_jaccard.keep_one_of_each(full, 5, 80, 100)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text, r.h) for r in full.withColumn("h", F.xxhash64("text")).collect()]
    s, root = classes([r[:2] for r in rows], 5, 80, 100)
    want = [str(r[:2]) for r, x in zip(rows, s) if not x]
    for g in {r for r, x in zip(root, s) if x}:
        want.append(str(min((r for r, y in zip(rows, root) if y == g), key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:2]))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(want)
    assert sum("of its own" in w or "no id and no copy" in w for w in want) == 2


def rows_text(docs, i):
    return docs.filter(f"doc_id = {i}").first().text


def brute_windows(rows, items):
    words = lambda t: [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) if x]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_HITS", most)  # with and without broadcasts
    items = [(i, sentence(random.choice([1, 3, 12, 13, 14, 30]))) for i in range(25)] + [(3, "again " + sentence(15)), (None, sentence(20)), (77, None), (78, " ! ")]
    rows = [(0, None), (1, ""), (1, ""), (None, items[4][1])]
    for d in range(2, 40):
        parts = [sentence(random.choice([0, 5, 200]))]
        for _ in range(random.randrange(3)):
            w = random.choice(items)[1] or ""
            parts += [w.upper() if random.random() < 0.3 else w.replace(" ", " - "), sentence(random.randrange(4))]
        rows.append((d, " ".join(parts)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(df, bench).collect()), key=str)
    want = brute_windows(rows, items)
    assert got == want
    clean = decontaminate.drop_contaminated(df, bench)
    full = [i for i in items if len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", i[1] or "")) >= 13]
    whole = [w[2] for w in sorted(brute_windows([(n, t) for n, (_, t) in enumerate(rows)], full), key=lambda w: w[0])]
    stays = sorted(str(d) for n, (d, t) in enumerate(rows) if not whole[n] and not next(w[5] for w in brute_windows([(n, t)], items)))
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == stays and 0 < len(stays) < len(rows)


def test_winnowing_keeps_one_of_every_window():
    g = np.random.default_rng(2).integers(0, 20, 500).astype(np.uint64)
    at = set(decontaminate.winnow(g, 9).tolist())
    for i in range(len(g) - 8):
        assert any(i <= a < i + 9 and g[a] == g[i : i + 9].min() for a in at)


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_files(spark, docs, tmp_path):
    path, tok = tokenizer()
    to = "file://" + str(tmp_path / "t")
    odd = spark.createDataFrame([(900, "It's  <|endoftext|>x  ÄB c İ Σ'Ll ''re é 'S.　q <|EndOfText|> a.b's")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    token_files.write_token_files(both, to, path, shard_tokens=2000)
    got = token_files.read_token_index(spark, to).orderBy("start").collect()
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted((str(r.doc_id), crc(ids(r.text)), len(ids(r.text))) for r in both.collect())
    assert sorted((str(r.doc_id), r.ids_crc32, r.n_tokens) for r in got) == want
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    full = {r.doc_id: r.ids for r in token_files.read_token_ids(spark, to).collect()}
    assert full[900] == ids(odd.first().text)


def test_re_pair_round_trip_and_windows():
    rng = np.random.default_rng(4)
    for vocabulary, n in ((50, 3000), (70_000, 500)):
        ids = rng.zipf(1.4, n).clip(max=vocabulary - 1).astype(np.uint32)
        counts = np.array([1, n // 3, 1, 1, n - n // 3 - 3])
        s = token_files.Shard(token_files.pack_shard(ids, counts, [None, 5, 6, 7, 8], vocabulary))
        assert (s.tokens(0, len(s.seq)) == ids).all() and s.doc_ids == [None, 5, 6, 7, 8]
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(5):
            doc = ids[at[i] : at[i + 1]]
            assert (s.document(i) == doc).all()
            for a, b in ((0, 1), (0, len(doc)), (len(doc) // 3, len(doc) // 2 + 1)):
                assert (s.window(i, a, b) == doc[a:b]).all()
    assert len(token_files.re_pair(np.array([3, 4] * 500, np.uint32), np.zeros(1000, bool), 50).seq) < 20


def test_re_pair_of_wide_symbols_and_of_many_rounds():
    """Pairs are counted alike whether key and place fit one number or not, and closed up or linked."""
    rng = np.random.default_rng(12)
    key, at = rng.integers(0, 40, 900).astype(np.uint64), np.arange(900) * 3
    for x, y in zip(token_files._by_key(key, at, 6), token_files._by_key(key, at, 60)):
        assert (x == y).all()
    passage = rng.integers(0, 200, 3000)
    ids = np.concatenate([rng.integers(0, 200, 20_000), np.tile(passage, 9), [7] * 501, [8, 8, 9] * 40])
    ends = np.zeros(len(ids), bool)
    ends[[0, 1, 19_999, -1]] = True
    a = token_files.re_pair(ids.astype(np.uint32), ends, 200)
    b = token_files.re_pair((ids + 2**30).astype(np.uint32), ends, 2**30 + 200)
    assert a.sizes == b.sizes and len(a.sizes) > 5 and not ends[2:19_999].any()
    for x, y in ((a.seq, b.seq), (a.left, b.left), (a.right, b.right)):
        assert (x.astype(np.int64) + 2**30 == y).all()
    flat, start, length = token_files.expansions(a.first, a.left, a.right, a.sizes)
    assert (np.concatenate([flat[start[s] : start[s] + length[s]] for s in a.seq]) == ids).all()
    assert len(a.seq) < 21_000


def test_token_shards_end_near_their_size(spark, tmp_path):
    """A shard passes ``shard_tokens`` by a slice at most; slices are small, as their arrays are to stay in cache."""
    path, _ = tokenizer()
    to = "file://" + str(tmp_path / "near")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('a b c d ', 200) AS text")
    token_files.write_token_files(docs, to, path, shard_tokens=200_000)
    sizes = [r.n_tokens for r in spark.read.parquet(to).select("n_tokens").collect()]
    assert sum(sizes) == 3000 * 801 and max(sizes) < 200_000 + 300_000


def test_freed_arrays_are_used_again():
    """Arrays allocated and freed again and again are not made of fresh pages each time."""
    import subprocess
    import sys

    pytest.importorskip("resource")
    code = """
import resource
import numpy as np
from voxlake.llm import textbatch as tb
if tb._LIBC is None:
    print(0)
else:
    tb.keep()
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    first = faults()
    for _ in range(20):
        held = [np.ones(3 << 17) for _ in range(8)]
        held = None
    print(faults() - first)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(got.stdout) < 20_000


def test_re_pair_leaves_no_frequent_pair():
    """Of what is left no pair inside a document has ``least`` uses that don't overlap; rules have their uses; 17-bit symbols."""
    rng = np.random.default_rng(9)
    for ids, vocabulary in ((rng.zipf(1.3, 40_000).clip(max=65_400), 65_500), (rng.integers(0, 3, 5000), 10), (np.tile([1, 1, 1, 2], 900), 10)):
        counts = np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, len(ids)), 40, replace=False)), [len(ids)])))
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(counts) - 1] = True
        g = token_files.re_pair(ids.astype(np.uint32), ends, vocabulary, least=8)
        s = token_files.Shard(token_files.pack_shard(ids.astype(np.uint32), counts, list(range(41)), vocabulary, least=8))
        assert (s.tokens(0, len(s.seq)) == ids).all() and (s.seq == g.seq).all()
        seen, last = defaultdict(int), {}
        for d in range(41):
            part = s.seq[s.at[d] : s.at[d + 1]].tolist()
            for i, pair in enumerate(zip(part, part[1:])):
                if last.get(pair) != (d, i - 1):  # a pair over itself counts once
                    seen[pair] += 1
                    last[pair] = (d, i)
        assert max(seen.values()) < 8
        assert all(b - a >= 0 for a, b in zip(s.at, s.at[1:]))


def test_sharding(docs):
    from pyspark.sql import functions as F

    rows = sharding.shard_documents(docs, 16).collect()
    texts = sorted((str(r.doc_id), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert sorted((str(r.doc_id), r.text_crc32, r["size"]) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    odd = sharding.with_shards(docs.withColumn("_shard", F.lit("a")).withColumn("_key", F.lit("b")).withColumn("_slot", F.lit("c")), 4)
    assert {(r._shard, r._key, r._slot) for r in odd.collect()} == {("a", "b", "c")}
    odd = mixing.mixed_documents(docs.withColumn("_copy", F.lit("a")).withColumn("_s", F.lit("b")), max_repeats=1.5)
    assert {(r._copy, r._s) for r in odd.collect()} == {("a", "b")}
    full = sharding.with_shards(docs, 16)
    assert full.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and full.count() == len(rows)


def test_jump_hash_moves_only_what_it_must():
    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump_hash(keys, n).tolist() == [one(int(k), n) for k in keys]
    moved = sharding.jump_hash(keys, 16) != sharding.jump_hash(keys, 17)
    assert (sharding.jump_hash(keys, 17)[moved] == 16).all() and abs(moved.mean() - 1 / 17) < 0.02


def test_topk(spark):
    """Large components, two rows of one query id, twice the same query row, nulls and ties, against all pairs."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(300)] + [(i, [0.5] * 20) for i in range(300, 340)]
    rows += [(20, rows[20][1]), (40, rows[7][1]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 20), (None, [1.0] * 20), (440, [1.0, 2.0]), (441, [2.0, 2.0]), (460, []), (461, [float("inf"), 1.0])]
    rows += [(500, [2.0**21] + [0.0] * 19), (501, [-(2.0**27) - 1 / 64] * 20), (520, [1e9, 3.0] + [0.25] * 18)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:20])]
    got = [tuple(r) for r in topk.exact_topk(df, query_block=8, vector_block=50).collect()]
    assert sorted(got) == sorted(want) and sum(r[0] == 20 and r[1] == 1 for r in got) == 2


def test_segment_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(50, 24)), rng.normal(size=(60, 24))
    for s in (1, 4, 7, 24):
        assert (topk.segment_bounds(x, s) @ topk.segment_bounds(y, s).T >= x @ y.T - 1e-9).all()


def brute_chat(rows):
    g, out = defaultdict(list), {}
    for c, t, r, x in rows:
        g[c].append(((t is not None, t or 0), r or "", x or ""))
    for c, v in g.items():
        v.sort()
        a, said = "".join(f"{r}\n{x}\n" for _, r, x in v), "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(a.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat(spark):
    rows = [(1, None, None, None), (1, 0, "system", "be \\ <|end|>\n x"), (None, 3, "user", "a"), (None, 3, "user", "a"), (2, 5, "a\nb", "q<"), (2, 6, "assistant", "<|turn|><<s>\\"), (3, 0, "user", "</s>[INST] ok [/INST]")]
    rows += [(9, i, random.choice(["user", "assistant", "system"]), " ".join(["w<s>é"] * random.choice([0, 1, 5, 40, 300]))) for i in range(-3, 1300)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    w = chat.format_chat(df, 200, 60).cache()
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_chat(w).collect()} == brute_chat(rows)
    for r in w.filter("conv_id = 9").collect():
        turns = chat.parse(r.text)
        tokens = [len(x.split()) + chat.MARKS for _, x in turns]
        assert sum(tokens) <= 200 or len(turns) - r.n_repeated == 1
        assert len(r.loss) == sum(a == "assistant" for a, _ in turns[r.n_repeated :])
    assert chat.format_chat(df.limit(0)).count() == 0
    # far turn numbers are as good as near ones
    some = [(1, i, random.choice(["user", "assistant"]), "a b " * (i % 5)) for i in range(1100)]
    near, far = (chat.format_chat(spark.createDataFrame([(c, t * x, r, y) for c, t, r, y in some], "conv_id long, turn long, role string, text string"), 200, 60).drop("conv_id").collect() for x in (1, 1000))
    assert sorted(map(str, near)) == sorted(map(str, far)) and max(r.span for r in near) == 2
    assert all(r.n_repeated > 0 for r in near if (r.span, r.window) != (0, 0))


def test_escape_is_reversible_and_hides_controls():
    for _ in range(3000):
        t = "".join(random.choice([*chat.CONTROLS, "\\", "<", "|", ">", "a", "\n", "[", "/"]) for _ in range(random.randrange(8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)
        assert chat.parse(chat.write_turn(t, t)[0]) == [(t, t)]


def test_line_dedup(spark):
    base = ["".join(random.choice("abcdé ") for _ in range(random.choice([3, 16, 17, 18, 30, 60]))) for _ in range(50)]

    def edit(s):
        s, i, k = list(s), random.randrange(len(s)), random.random()
        if k < 0.3:
            s[i] = random.choice("abxé")
        elif k < 0.6:
            del s[i]
        elif k < 0.9:
            s.insert(i, random.choice("abxé"))
        return "".join(s)

    some = [lambda: random.choice(base), lambda: edit(random.choice(base)), lambda: "", lambda: "  ", lambda: edit(edit(random.choice(base)))]
    rows = [(d, None if d == 7 else "\n".join(random.choice(some)() for _ in range(random.randrange(6)))) for d in range(100)] + [(None, base[0] + "\n" + base[1]), (3, base[2])]
    rows += [(3, base[2] + "\n" + "only here, in the second text of this id"), (None, base[4] + "\nonly here, without an id"), (9, rows[8][1]), (8, rows[8][1])]
    rows = [(d, t) for d, t in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, dropped string, k int").repartition(3)
    from pyspark.sql import functions as F

    key = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    least = line_dedup._NULL_ID
    name = lambda d, t: (least if d is None else d, key[t])
    lines = sorted({(name(d, t), i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")})
    drop = defaultdict(set)
    for a, b, x in lines:
        if any((c, e) < (a, b) and (y == x or (len(x) >= 16 and len(y) >= 16 and levenshtein(x, y) <= 1)) for c, e, y in lines):
            drop[a].add(b)
    want = sorted(((d, len(t.split("\n")) if t is not None else 0, sorted(drop.get(name(d, t), ()))) for d, t in rows), key=str)
    got = sorted(((r.doc_id, r.n_lines, list(r.dropped)) for r in line_dedup.dropped_lines(df).collect()), key=str)
    assert got == want
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop.get(name(d, t), ()))) for d, t in rows]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(texts, key=str)
    assert sum("only here" in (t or "") for _, t in texts) == 2


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The registered query: lines of any length, but blank ones, one character apart."""
    rows = [(0, "Share this!\na\n \nRead more"), (1, "Share this.\nb\nab\n"), (2, "Read more.\nRead  mores\nabcd\n\nxyz"), (3, "abc\nfifteen letters\nq"), (4, "sixteen letters\nfifteen letters!\nxz\nqqqq")]
    rows += [(10 + d, "\n".join("".join(random.choice("ab ") for _ in range(random.randrange(7))) for _ in range(4))) for d in range(12)]
    to = "file://" + str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{to}/documents.parquet")
    lines = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip()]
    want = {d: [i for e, i, x in lines if e == d and any((f, j) < (e, i) and levenshtein(x, y) <= 1 for f, j, y in lines)] for d, _ in rows}
    assert want[1] == [0, 1, 2] and want[2][0] == 0
    assert {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in op_queries.QUERIES["op5_line_dedup"](spark, to).collect()} == want


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    first = np.concatenate(([0], np.cumsum(rng.integers(0, 300, 25))))
    s = rng.normal(0, 3, (first[-1], 4)).astype(np.float32)
    got = language_id.viterbi(s, first, 6.0)
    value = lambda a, b: sum(s[i, got[i]] for i in range(a, b)) - 6 * sum(got[i] != got[i - 1] for i in range(a + 1, b))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        v = np.zeros(4)
        for i in range(a, b):
            v = np.maximum(v, v.max() - 6 if i > a else v) + s[i]
        if b > a:
            assert abs(value(a, b) - v.max()) < 1e-2


def test_language_id(spark):
    en, ru = "the quick brown fox jumps over lazy dogs and runs", "быстрая лиса прыгает через ленивую собаку"
    fr = "être déjà vu où garçon élève français à l'école"
    train = spark.createDataFrame([(t, lang) for t, lang in ((en, "en"), (ru, "ru"), (fr, "fr"), ("zzz qqq", None))] * 5, "text string, lang string")
    m = language_id.learn(train)
    assert m.langs == ["en", "fr", "ru"]
    rows = [(0, en), (1, ru), (2, fr), (3, None), (4, ""), (5, "12 !? 34"), (6, (en + " ") * 3 + (ru + " ") * 3), (7, en.upper())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang_pred string")
    from pyspark.sql import functions as F

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, m, {"doc_id": (F.col("doc_id"), "long")}).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 5, 7)] == ["en", "ru", "fr", "und", "und", "und", "en"] and got[3][1] == 0 and got[0][1] == 1
    spans = [(r.lang, r.start) for r in language_id.language_spans(df.filter("doc_id = 6"), m).orderBy("start").collect()]
    assert [x for x, _ in spans] == ["en", "ru"]
    kept = language_id.keep_identified(df, m, 0.3)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6, 7]
    none = language_id.learn(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none, {"doc_id": (F.col("doc_id"), "long")}).collect()} == {"und"}


def test_quality(spark):
    from pyspark.sql import functions as F

    rows, labels = [], []
    for i in range(400):
        g = i % 3
        words = [random.choice("alpha beta gamma delta eps".split()) for _ in range(30)] + (["vile", "scum"] if g == 0 else ["junk$$$"] * 3 if g == 1 else [])
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, g))
    rows += [(1000, None), (1001, ""), (None, "alpha beta")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels[:300], (5000, 1), (1, None), (None, 2)], "doc_id long, grade int")
    m = quality.learn(df, lab, F.col("grade"), 3)
    assert m.thresholds[0] < m.thresholds[1]
    got = {r.doc_id: r for r in quality.grade_documents(df, m).collect()}
    assert len(got) == len(rows)
    right = [round(got[i].expected_grade) == g for i, g in labels[300:]]
    assert np.mean(right) > 0.95
    assert all(0 <= got[i].tails[1] <= got[i].tails[0] <= 1 for i in got)
    blank = quality.learn(df, lab.limit(0), F.col("grade"), 3)
    assert quality.grade_documents(df, blank).count() == len(rows) and quality.grade_documents(df.limit(0), m).count() == 0


def test_quality_sends_ids_without_python_workers(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql import functions as F

    df, lab = spark.createDataFrame([(i, f"word{i % 2} " * 9) for i in range(60)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")
    started, real = [], SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **b: started.append(a) or real(self, *a, **b))
    m = quality.learn(df, lab, F.col("grade"), 2)
    assert not started and m.weights.any()


def test_mixing_plan_and_draws(spark, docs):
    out = mixing.mix_sources(docs, max_repeats=1.5, block_tokens=500)
    rows = out.collect()
    t, own = defaultdict(int), defaultdict(list)
    for r in docs.collect():
        n = len([x for x in re.split("[\x20\x09-\x0d]+", r.text or "") if x])
        t[r.source] += n
    weights = {r.source: r.weight for r in rows}
    shares = np.array([t[s] for s in weights], float)
    x = mixing.find_exponent(shares, max_repeats=1.5)
    w = mixing.weights_at(shares / shares.sum(), x)
    assert np.allclose(w, list(weights.values()))
    total = mixing.full_budget(shares, w)
    assert (w * total / shares).max() <= 1.5 + 1e-6 and (w * total / shares).min() >= 1 - 1e-9
    for r in rows:
        own[r.source].append(r)
    for s, weight in weights.items():
        drawn, most = sum(r.tokens for r in own[s]), max(r.tokens for r in own[s])
        assert weight * total - most - 1 <= drawn <= weight * total + 1
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.block].append(r.slot)
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())
    assert {str(r.doc_id) for r in rows} == {str(r.doc_id) for r in docs.collect()}
    again = mixing.mixed_documents(docs, max_repeats=1.5)
    assert again.columns == docs.columns and again.count() == len(rows)


def test_find_exponent():
    t = np.array([8.0, 1.0, 1.0])
    e = mixing.entropy(mixing.weights_at(t / 10, 0.4))
    assert mixing.find_exponent(t, target_entropy=e) == pytest.approx(0.4, abs=1e-9)
    assert mixing.find_exponent(t, max_repeats=8.1) == 0.0
    for impossible in ({"max_repeats": None}, {"budget": 30.0, "max_repeats": 2.0}):
        with pytest.raises(ValueError):
            mixing.find_exponent(t, **impossible)
    x = mixing.find_exponent(t, budget=10.0, max_repeats=2.0)
    assert (mixing.weights_at(t / 10, x) * 10 / t).max() == pytest.approx(2.0)


def test_empty_tables(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_jaccard.ngram_jaccard_components(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert {r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()} == {False}
    assert line_dedup.dropped_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    path, _ = tokenizer()
    to = "file://" + str(tmp_path / "none")
    token_files.write_token_files(none, to, path)
    assert token_files.read_token_index(spark, to).count() == 0
    m = language_id.learn(none)
    assert language_id.predict(none, m, {"doc_id": (F.col("doc_id"), "long")}).count() == 0
