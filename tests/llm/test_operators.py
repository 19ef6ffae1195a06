"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import struct

import pytest

from lumenfold.llm import bpe, chat, exact, html, mixing, near, quality_rules, ranking, sample, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size long, n_words long"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    vocabulary = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 40
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 80, 300]))) for _ in range(60)]
    texts = base + base[:10] + [t + " " for t in base[10:14]] + [None, None, "", " \n\t", "a", "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab", "x " * 40, "x " * 25 + "y"]
    texts += [" ".join(w if i % 97 else "changed" for i, w in enumerate(t.split())) for t in base[20:30]]
    passage = " ".join("p%d" % i for i in range(60))
    texts += [f"{rnd.choice(base)[:80]} {passage} tail{i}" for i in range(6)] + [" ".join(rnd.choice(vocabulary) for _ in range(9000))]
    texts += ["été　naïve\x1cword 日本語 <|endoftext|> 's 12  3\n\n x"]
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 4}", len(t or ""), "n", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_exact(docs, rows):
    groups = collections.defaultdict(list)
    for r in rows.values():
        groups[b"".join(words_of(r.text))].append(r)
    got = {r.doc_id: r for r in exact.exact_dedup(docs).collect()}
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id
        for r in members:
            g = got[r.doc_id]
            assert (g.keep_id, g.group_size, g.kept, g.text_sha256) == (keep, len(members), r.doc_id == keep, hashlib.sha256(text).hexdigest())
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_near(docs, rows):
    sets = {}
    for i, r in rows.items():
        w = words_of(r.text)
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in rows:
        for j in rows:
            if i < j and (sets[i] == sets[j] or sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.82 * sum((sets[i] | sets[j]).values())):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r for r in near.near_duplicates(docs).collect()}
    assert {i: g.class_id for i, g in got.items()} == {i: root(i) for i in rows}
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in rows})


def test_substring(docs, rows):
    least = {}
    for i in sorted(rows):
        w = words_of(rows[i].text)
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring.repeated_words(docs).collect()}
    for i, r in rows.items():
        w = words_of(r.text)
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        g = got[i]
        assert (g.n_words, g.n_removed, g.kept_sha256, g.kept_text) == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())


def test_mixing(docs, rows):
    got = {r.doc_id: r for r in mixing.mix(docs, shards=8, block_words=500).collect()}
    assert got.keys() == rows.keys()
    by = collections.defaultdict(list)
    for i, g in got.items():
        assert g["size"] == len(words_of(rows[i].text)) and g.taken == g.epochs * g["size"] + g.rest == sum(d.words for d in g.draws) and g.taken <= 3 * g["size"]
        by[rows[i].source].append(g)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(g["size"] for g in by[s]) for s in names]
    goal = [sum(sizes) * (k % 3 + 1) / sum(k % 3 + 1 for k in range(len(names))) for k in range(len(names))]
    capped = set()
    while over := [k for k in range(len(names)) if k not in capped and goal[k] > 3 * sizes[k]]:
        capped |= set(over)
        left = sum(sizes) - sum(3 * sizes[k] for k in capped)
        free = sum(k % 3 + 1 for k in range(len(names)) if k not in capped)
        goal = [3 * sizes[k] if k in capped else left * (k % 3 + 1) / free for k in range(len(names))]
    for s, size, t in zip(names, sizes, goal, strict=True):
        assert all(abs(g.target - t) < 1e-6 and g.source_size == size for g in by[s])
        assert abs(sum(g.taken for g in by[s]) - t) <= 0.5
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(5), shards=8, block_words=500).collect()}
    assert again == got
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    total = sum(len(words_of(r.text)) for r in out.collect())
    assert abs(total - sum(sizes)) <= len(names)


def test_mixed_rows_lie_by_shard_and_place(docs):
    draws = sorted((d.shard, d.place, r.doc_id) for r in mixing.mix(docs, shards=8, block_words=500).collect() for d in r.draws)
    want = {s: [i for t, _, i in draws if t == s] for s in range(8)}
    parts = mixing.mixed(docs, shards=8, block_words=500).where(r"text RLIKE '[^\\x20\\x09-\\x0D]'").select("doc_id").rdd.glom().map(lambda rows: [r.doc_id for r in rows]).collect()
    left = set(want)
    for part in parts:
        while part:
            s = next(s for s in sorted(left) if want[s] and part[: len(want[s])] == want[s])
            left.remove(s)
            part = part[len(want[s]) :]
    assert not any(want[s] for s in left)


def test_pipeline_mixes_whole_documents(spark):
    """Many small sources: texts stay whole and totals near their targets; a single long text that overshoots is cut."""
    import corpus_pipeline

    def run(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = collections.defaultdict(list)
        for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
            got[r.source].append(r)
        return {r.source: r.target for r in mixing.mix(docs).collect()}, got

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i)), f"s{i // 2:02}") for i in range(30)] + [(99, "", "s00")]
    goal, got = run(rows)
    assert [r.text for r in got["s00"]].count("") == 1
    for i, t, s in rows[:30]:
        assert all(r.text == rows[r.doc_id][1] for r in got[s] if r.text)
        assert abs(sum(len(r.text.split()) for r in got[s]) - goal[s]) <= (40 + i // 2 * 2 + 1) / 2 + 1
    # The small texts are all taken three times, and the whole long text is more than half over the rest.
    goal, got = run([(0, " ".join(["long"] * 3000), "a")] + [(i, " ".join(["word"] * 200), "b") for i in range(1, 4)])
    assert goal["a"] == 1800 and [len(r.text.split()) for r in got["a"]] == [1800] and [len(r.text.split()) for r in got["b"]] == [200] * 9


def test_splitting_tree_is_exact():
    """Every source's blocks and every shard's room come out exact, and the mean share is the hypergeometric one."""
    import numpy as np

    counts, room = np.array([5, 0, 17, 40]), np.array([8, 9, 9, 9, 9, 9, 9])
    mean = np.zeros((4, 7))
    for seed in range(300):
        got = mixing.split(counts, room, [seed])
        assert got.sum(1).tolist() == counts.tolist() and got.sum(0).tolist() == room.tolist() and (got >= 0).all()
        mean += got / 300
    assert np.abs(mean - np.outer(counts, room) / 62).max() < 0.5


def test_mixing_draws_by_the_tree(docs):
    """Blocks decide what is taken: a document's draws are its block's, every shard gets its quota of blocks, and another seed draws others."""
    got = mixing.mix(docs, shards=4, block_words=300).collect()
    again = mixing.mix(docs, shards=4, block_words=300, seed=18).collect()
    total = lambda rows: {s: sum(r.taken for r in rows if r.source == s) for s in {r.source for r in rows}}
    assert total(got) == total(again)
    assert {(r.doc_id, r.taken) for r in got} != {(r.doc_id, r.taken) for r in again}
    size = {r.source: r.source_size for r in got}
    blocks = {}
    for r in got:
        parts = -(-size[r.source] // 300)
        for d in r.draws:
            blocks.setdefault((r.source, r.spot * parts >> mixing.LINE_BITS, d.epoch), set()).add(d.shard)
    assert all(len(x) == 1 for x in blocks.values())
    per = collections.Counter(next(iter(x)) for x in blocks.values())
    assert max(per.values()) - min(per.values()) <= 1


def test_mixing_repeated_and_null_ids(spark):
    """Rows that share an id or have none are rows of their own: every source meets its target."""
    rows = [(None if i % 2 else 7, " ".join(f"a{i}x{j}" for j in range(31)), "a") for i in range(80)]
    rows += [(100 + i, " ".join(f"b{j}" for j in range(29 + i)), "b") for i in range(60)] + [(5, "same words here", None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, block_words=200).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(r.taken <= 3 * r["size"] for r in mine)
    out = mixing.mixed(docs, block_words=200).collect()
    words = collections.Counter(r.source for r in out for _ in r.text.split())
    assert all(words[s] == sum(r.taken for r in got if r.source == s) for s in words)


def test_mixing_many_sources(spark, monkeypatch):
    """Beyond the bound for broadcasts, sources and blocks join by shuffle and groups of sources split in tasks of their own: the same targets."""
    rows = [(i, "w " * (i % 9), f"s{i % 37:02}" if i % 41 else None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.target) for r in mixing.mix(docs, block_words=20).collect())
    monkeypatch.setattr(mixing, "FEW", 3)
    monkeypatch.setattr(mixing, "GROUP", 5)
    got = mixing.mix(docs, block_words=20, shards=6).collect()
    assert sorted((r.doc_id, r.target) for r in got) == want
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
        assert all(r.taken == sum(d.words for d in r.draws) for r in mine)


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in rows] + [(None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    for g in quality_rules.apply_rules(docs, labels).collect():
        t = rows[g.doc_id].text or ""
        w = words_of(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        rep = {p for k, x in enumerate(tri) if n[x] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert g.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_binomial_bound(spark):
    """Exact within the terms summed; with fewer terms the bound errs upwards, and by little."""
    import math

    for k, n, p in ((0, 10, 0.02), (3, 400, 0.02), (20, 2000, 0.02), (150, 9000, 0.02), (1500, 90_000, 0.02)):
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        for terms in (quality_rules.TERMS, 12):
            got = spark.sql(f"SELECT {quality_rules.binomial_at_most('k', 'n', p, terms)} AS x FROM (SELECT CAST({k} AS BIGINT) AS k, CAST({n} AS BIGINT) AS n)").first().x
            assert abs(got - want) < 1e-9 if terms > k else want * (1 - 1e-6) <= got <= 10 * want


def test_cutoffs_by_brute_force(spark):
    """The chosen and certified rules of every stratum, against plain loops; no stratum's rules together reject more than the bound allows."""
    import math

    rnd = random.Random(12)
    rows = []
    for i in range(5000):
        w = [f"{rnd.choice('abcde')}{rnd.randint(0, 400)}" for _ in range(60)]
        good = rnd.random() < 0.8
        lang = rnd.choice(["en", "de", None])
        if not good and rnd.random() < 0.6:
            w = [x + "##" for x in w] if rnd.random() < 0.5 else [x.upper() + "ZZ" for x in w]
        elif good and rnd.random() < (0.06 if lang == "de" else 0.001):
            w = [x + "#" for x in w]
        rows.append((i, " ".join(w), lang, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    measured = quality_rules.measure(docs).cache()
    values = {r.doc_id: r for r in measured.selectExpr("doc_id", "base_failed", *[f"{e} AS {n}" for n, (e, _) in quality_rules.RULES.items()]).collect()}
    want = []
    strata = {r[2] or "" for r in rows}
    for stratum in strata:
        mine = [r for r in rows if (r[2] or "") == stratum and not values[r[0]].base_failed]
        pick = [hashlib.md5(str(r[0]).encode()).hexdigest()[0] < "8" for r in mine]
        found = []
        for number, (name, (_, cuts)) in enumerate(quality_rules.RULES.items()):
            tries = []
            for step, c in enumerate(cuts):
                n, k, caught = (sum(p and r[3] == g and (not hits or values[r[0]][name] > c) for r, p in zip(mine, pick, strict=True)) for g, hits in ((1, 0), (1, 1), (0, 1)))
                if caught and k <= n * quality_rules.RISK / (2 * len(quality_rules.RULES)):
                    tries.append((-caught, step, c))
            if tries:
                found.append((min(tries)[0], number, name, min(tries)[2]))
        rules = []
        for caught, _, name, c in sorted(found):
            rules.append((name, c))
            clean = [r for r, p in zip(mine, pick, strict=True) if not p and r[3] == 1]
            k, n = sum(any(values[r[0]][x] > y for x, y in rules) for r in clean), len(clean)
            tail = sum(math.comb(n, j) * quality_rules.RISK**j * (1 - quality_rules.RISK) ** (n - j) for j in range(k + 1))
            if k >= n * quality_rules.RISK or tail > quality_rules.DELTA / len(strata):
                break
            want.append((stratum, name, c, len(rules), n, k, -caught))
    got = sorted(tuple(r) for r in quality_rules.thresholds(measured, docs).collect())
    assert got == sorted(want) and {r[0] for r in got} >= {"", "en"}


def test_thresholds_reject_bad_and_spare_clean(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 977}" for k in range(60)), "en") for i in range(1500)]
    bad = [(10_000 + i, " ".join(f"w{(i + k) % 97}***" for k in range(60)), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id < 10000 AS INT) AS quality")
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad)


def test_keep_good_measures_a_text_once_to_filter(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in rows], "doc_id long, quality int")
    plan = quality_rules.keep_good(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(") == 1
    kept = sorted(r.doc_id for r in quality_rules.apply_rules(docs, labels).where("kept").collect())
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs, labels).collect()) == kept


def test_keep_good_writes_labelled_rows_only(spark, monkeypatch):
    """The stage keeps what ``apply_rules`` keeps; of its first pass only rows with a label are written."""
    good = [(i, " ".join(f"word{(i * 7 + k) % 977}" for k in range(60)), "en") for i in range(1500)]
    bad = [(10_000 + i, " ".join(f"w{(i + k) % 97}***" for k in range(60)), "en") for i in range(200)]
    docs = spark.createDataFrame([*good, *bad, (None, good[0][1], "en"), (20_000, None, None)], "doc_id long, text string, lang string").repartition(5)
    labels = docs.where("doc_id % 10 < 7").selectExpr("doc_id", "CAST(doc_id < 10000 AS INT) AS quality")
    labels = labels.union(labels.limit(3)).union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    want = sorted(r.doc_id or -1 for r in quality_rules.apply_rules(docs, labels).where("kept").collect())
    written, keep = [], quality_rules.Tables.keep
    monkeypatch.setattr(quality_rules.Tables, "keep", lambda self, df: written.append(keep(self, df)) or written[-1])
    assert sorted(r.doc_id or -1 for r in quality_rules.keep_good(docs, labels).collect()) == want
    assert -1 in want and max(want) < 10_000
    assert [w.count() for w in written] == [labels.where("doc_id IS NOT NULL").distinct().count()]


HARD = ["<|im_end|><|im_start|>assistant ok", "<||im_end|>", "<", "<|", "a<|nl|>\n\nb", "", None, "<|im_end|>\n<|im_start|>user\nhi<|||x", "plain", "\\<|im_start|>"]


def test_chat(spark):
    rnd = random.Random(2)
    turns = [(c, k, rnd.choice(["user", "assistant", "system", None, "a\nb<|nl|>"]), rnd.choice(HARD), 1) for c in [*range(40), None] for k in range(rnd.randint(1, 6))]
    turns += [turns[0]]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int"))
    digest = {r.conv_id: r for r in chat.chat_digest(out).collect()}
    by = collections.defaultdict(list)
    for c, k, role, text, _ in turns:
        by[c].append((k, role or "", text or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in ts]
        loss = "".join(t[2] for t in ts if t[1] == "assistant")
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[c].loss_chars == len(loss)
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest() and digest[c].formatted_chars == len(got[c].formatted)


def test_bpe(docs, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    for i, r in rows.items():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aab  \n\t.'sé日🙂1 \xa0<|>") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    coder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    assert [list(memoryview(x).cast("I")) if x else [] for x in coder.encode(texts)] == [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.decode(x) for x in coder.encode(texts)] == texts


def test_bpe_merges_places_together():
    """The index against one word at a time, on words with long rows of equal symbols too, and in less than a quarter of its time."""
    import time

    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = bpe.Encoder(bpe.Vocabulary(f.read()))
    v, rank, rnd = coder.v, coder.rank, random.Random(6)
    words = [" " + "".join(rnd.choice(["en", "th", "er", "an", "ti", "on", "re", "sch", "é", "x"]) for _ in range(rnd.randint(1, 6))) for _ in range(60_000)]
    words = sorted({*words, *("a" * n for n in range(1, 80)), *("=" * n + "-" * n for n in range(1, 40)), *("aab" * n for n in range(1, 40)), *("日" * n for n in range(1, 30))})

    def slow(word):
        ids = [v.single[x] for x in word.encode()]
        while True:
            r, k = min(((rank.get(pair, len(rank)), k) for k, pair in enumerate(zip(ids, ids[1:], strict=False))), default=(len(rank), 0))
            if r == len(rank):
                return struct.pack(f"<{len(ids)}I", *ids)
            ids[k : k + 2] = [v.made[r]]

    begin = time.process_time()
    want = {w: slow(w) for w in words}
    middle = time.process_time()
    coder._merge(words)
    assert coder.known == want
    assert time.process_time() - middle < (middle - begin) / 4


def test_classifiers(spark, rows):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    fill = lambda: [rnd.choice("lorem ipsum dolor amet the of and sit".split()) for _ in range(60)]
    data = []
    for i in range(1200):
        w, toxic = fill(), int(i % 5 == 0)
        # Toxic only together: each word alone is harmless.
        w += ["insult", "group"] if toxic else [["insult"], ["group"], []][i % 3]
        bad = i % 4 == 1
        rnd.shuffle(w)
        data.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), toxic, int(not bad)))
    data += [(9001, None, None, None), (9002, "", 0, 1), (9003, "é" * 5000, 0, 1)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, *_ in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in data], "doc_id long, toxic int, quality int")
    for got, at in ((toxicity.score_toxicity(docs, labels, sample.remainder(labels["doc_id"], 5) != 0), 2), (ranking.score_quality(docs, labels, sample.remainder(labels["doc_id"], 3) != 1), 3)):
        scores = {r.doc_id: r.score for r in got.collect()}
        assert scores.keys() == {d[0] for d in data} and all(0 <= s <= 1 for s in scores.values())
        right = sum((scores[d[0]] >= 0.5) == d[at] for d in data[:1200])
        assert right > 1150
    assert toxicity.score_toxicity(docs, labels.where(F.lit(False)), F.lit(True)).count() == len(data)
    assert ranking.score_quality(docs, labels.where(F.lit(False)), F.lit(True)).count() == len(data)


def test_every_telling_term_enters_the_machine():
    """600 terms tell toxic texts, each in a few of them: all are learnt, not only the first by z."""
    import numpy as np

    rnd = np.random.default_rng(5)
    docs = [np.unique(np.concatenate([rnd.integers(10_000, 11_000, 20), rnd.integers(0, 600, 20) if i % 2 else []])).astype(np.int64) for i in range(4000)]
    model = toxicity.fit(docs, np.array([i % 2 for i in range(4000)], np.float32), rounds=50)
    assert set(range(600)) <= set(model.slots.tolist())
    for t in range(600):
        assert model.raw(np.zeros(1, np.int64), np.array([t]), 1)[0] > model.w0


PAGES = {
    "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp; two<br>three<p>Four &lt;b&gt;<script>var x='</p>';</script></article><footer>c</footer>": "Head One & two three Four <b>",
    "<body><div id=menu><ul><li><a>A</a></ul></div><div><p>The cat sat on the mat and it was the best of all the places that it had been to.</p><p>Short.</p></div><div class='comments'><p>I think that the text is not good and that it is of no use to me.</p></div>": "The cat sat on the mat and it was the best of all the places that it had been to. Short.",
    "<article><header><h1>T</h1></header><p>Body</p><aside>rel</aside><form><p>mail</p></form><div class='comment-list'><p>nice</p></div><p hidden>no</p></article>": "T Body",
    "": "", "<p": "", "a < b": "a < b",
}


def test_html(spark):
    rows = list(enumerate(PAGES)) + [(99, None)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(i, None, h, 1) for i, h in rows], "page_id long, url string, html string, text int")).collect()}
    for (i, h) in rows:
        assert got[i].text == PAGES.get(h, "") and got[i].n_chars == len(got[i].text)


PROSE = "The cat sat on the mat and it was the best of all the places that it had been to in the whole of the day."
TEASER = "Read more on the story of the dog that was in the garden with a ball."


def test_html_article_is_not_all():
    """Both passes decide on pages with an article: text outside it stays, link lists inside it and what lies between them go."""
    assert html.main_text(f"<div><p>{PROSE}</p><p>So it was.</p><article><p>{TEASER}</p></article><p>{PROSE}</p></div>") == f"{PROSE} So it was. {TEASER} {PROSE}"
    lists = "<p><a href=x>One story</a></p><p>See also</p><p><a href=y>Two stories</a></p>"
    assert html.main_text(f"<article><p>{PROSE}</p>{lists}<ol class=commentlist><li>{TEASER}</li></ol></article>") == PROSE
    assert html.main_text(f"<article><p>{PROSE}</p><p>So it was.</p><p><a href=x>One story</a></p></article>") == f"{PROSE} So it was."


@pytest.mark.parametrize("wrapper", ["div class=has-sidebar", "div class='content no-comments'", "div id=page-with-header", "div class=widget-area", "section class='menu'", "div class=tag-legal"])
def test_html_wrapper_names(wrapper):
    """A layout class around the page, or a topic class of the article, leaves the text."""
    for topic in ("post category-legal", "social-policy", "format-form share", "tags", "legal"):
        page = f"<body><{wrapper}><p>{TEASER}</p><article class='{topic}'><p>{PROSE}</p></article><div class=site-footer><p>{PROSE}</p></div></{wrapper.split()[0]}><div class='sidebar-box'>{PROSE}</div>"
        assert html.main_text(page) == f"{TEASER} {PROSE}"
    if "area" not in wrapper and "menu" not in wrapper:
        assert html.main_text(f"<{wrapper}><p>{PROSE}</p></{wrapper.split()[0]}>") == PROSE
    assert html.main_text(f"<main><p>{PROSE}</p></main><div class=post-comments><article class=comment-body><p>{TEASER}</p></article></div><nav><article>{TEASER}</article></nav>") == PROSE


@pytest.mark.parametrize("text", ["Кот сидел у окна и смотрел на снег " * 8, "Kot siedział przy oknie, patrzył jak pada śnieg " * 8, "كانت القطة تجلس قرب النافذة " * 10, "猫は窓のそばに座って、雪を見ていた。" * 8, "猫坐在窗边看着外面的雪，" * 12, "x1 = f(y2); " * 40])
def test_html_other_languages(text):
    """Long text is main text in any language; a short block beside boilerplate elements is not lost with them."""
    text = text.strip()
    page = f"<header><p>{PROSE}</p></header><nav><a href=x>Home</a></nav><div><p>{text}</p><p>So?</p></div><ul><li><a href=y>More</a></li></ul><footer>c</footer>"
    assert html.main_text(page) == f"{text} So?"
    assert html.main_text(f"<p>{text[: len(text) // 2]}<a href=x>{text[len(text) // 2 : len(text) * 4 // 5]}</a>{text[len(text) * 4 // 5 :]}</p><p><a href=y>More</a></p>") == text
    assert html.main_text(f"<p>{PROSE} {PROSE}</p><p><a href=y>More</a></p><pre>{text}</pre><p><a href=y>More</a></p>") == f"{PROSE} {PROSE} {text}"


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    assert not exact.exact_dedup(none).count() and not near.near_duplicates(none).count() and not substring.repeated_words(none).count() and not mixing.mix(none).count()
    assert not quality_rules.apply_rules(none, labels).count() and not toxicity.score_toxicity(none, labels, F.lit(True)).count() and not ranking.score_quality(none, labels, F.lit(True)).count()
    assert not chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() and not html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count()


def test_dotted_columns(spark):
    """Columns whose names hold dots or clash with the operators' own pass through whole-row stages."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + f" {i % 3}", "en", "s", 1, 2) for i in range(6)], "doc_id long, text string, lang string, source string, `a.b` int, row int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact.drop_exact_copies(docs), near.drop_near_copies(docs), mixing.mixed(docs), quality_rules.keep_good(docs, labels)):
        assert out.columns == docs.columns and all(r["a.b"] == 1 and r["row"] == 2 for r in out.collect())
