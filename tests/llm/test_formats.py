"""Chat windows, URL filters and mixing against brute force and exact round trips; the whole pipeline on a small corpus."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, mixing, urls

SAID = "\\### Assistant: </turn> ok"
PIECES = ["a", "b c", "\\", "\\\\", "#", "###", "<", "</turn>\n", "\\h", "\\l", ":", "\n", "é", "\U0001f600", " ", SAID]


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(25):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(1, 12)
        for turn, role in enumerate(roles):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) + " word" * rng.randint(0, 30)
            rows.append((c, turn * 2 - 3, role, rng.choice([text, text, text, None, ""]) if c % 4 == 0 else text))
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (99, None, None, "z"), (99, None, None, "z"), (98, 1, "ro:le\\c#<", "q")]
    rng.shuffle(rows)
    return rows


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, words int, span string").repartition(3)
    formatted = chat.windows(df, stride=20, history=8)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        target = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for r in formatted.collect():
        turns = r["text"].split("</turn>\n")[:-1]
        longest = max((len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, _, _, t in by[r["conv_id"]]), default=0)
        assert r["n_repeated"] < len(turns) and r["n_words"] <= 20 + 8 + 2 * longest
        assert all(r["text"][s["start"] - len("assistant: ") : s["start"]] == "assistant: " for s in r["loss"])
    repeats = [r for r in formatted.collect() if r["window"] > 0 and r["conv_id"] is not None and r["conv_id"] % 3 == 0]
    assert repeats and all(r["text"].startswith("### system: ") for r in repeats)


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(none)).count() == 0


URLS = [
    "http://A.Example.ORG/es/1?q=1", "https://x.org", "https://org/", "http://example.org/en/12#f", "http://notexample.org/en/1", "http://a.com/fr/x", "http://a.com/fr", "http://com/de/", "http://www.a.com:80/de/1",
    "no scheme", "", None, "://", "ftp://h?x/y", "http://h#/de/", "http://example.org/es/\nline", "HTTP://EXAMPLE.ORG/ES/", "http://a.com/de/?u=http://b.org/", "http://é.com/fr/é",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_given_url_rules(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "clash", "x"), (0, URLS[0], "clash", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    mined = urls.mine(df.selectExpr("url", "cast(null as boolean) as blocked"))
    got = urls.judge(df, mined).collect()
    assert len(got) == len(rows) and mined.count() == 0
    for i, u in enumerate(URLS):
        r = next(r for r in got if r["page_id"] == i)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(u), u
    assert urls.judge(df.limit(0), mined).count() == 0


def test_mined_url_rules(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        host, part = rng.choice(["ads", "news", "blog"]), rng.choice(["buy", "read", "see"])
        bad = host == "ads" and part == "buy"
        rows.append((i, f"http://{host}.site.net/{part}/{i}", bad if rng.random() < 0.97 else not bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean").repartition(3)
    mined = urls.mine(df)
    rules = {tuple(x[0] for x in r["antecedent"]): r for r in mined.collect()}
    assert ("h:ads", "p:buy") in rules
    base = sum(b for *_, b in rows) / len(rows)
    for tokens, r in rules.items():  # figures by counting
        fits = [b for _, u, b in rows if all(re.search(rf"\b{t[2:]}\b", re.sub("[0-9]+", "0", u)) for t in tokens)]
        assert abs(r["confidence"] - sum(fits) / len(fits)) < 1e-9 and r["n"] == len(fits) and says_something(sum(fits), len(fits), base)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, mined).collect()}
    assert all(got[i] == ("block" if "ads." in u and "/buy/" in u else "allow") for i, u, _ in rows)


def says_something(hits, n, base):
    if not n or hits / n < max(urls.MIN_CONFIDENCE, base):
        return False
    share = hits / n
    return n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)) >= -math.log(urls.CHANCE)


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_are_complete(spark, seed):
    """Verdicts by counting every combination of up to three tokens, none left out; 20 tokens that all URLs share, and 20 that a site shares, don't multiply item sets."""
    rng = random.Random(seed)
    everywhere, site = ".".join(f"all{chr(97 + i)}" for i in range(20)), "/".join(f"site{chr(97 + i)}" for i in range(20))
    rows = []
    for i in range((500, 281, 294)[seed]):
        path = [p for p in ("buy", "win", "cash", "news", "read") if rng.random() < 0.5]
        bad = {"buy", "win"} <= set(path) and rng.random() < 0.8 or ({"win", "cash", "news"} <= set(path) and "read" not in path)
        path += [p for p in ("aa", "bb") if rng.random() < 0.1]  # each says nothing, both together much
        bad = ("aa" in path and "bb" in path) or (bad and "aa" not in path)
        own = site if rng.random() < (0.5 if bad else 0.3) else "home"
        rows.append((i, f"https://{everywhere}/{own}/{'-'.join(path)}/{i}", bad if rng.random() < 0.95 else not bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean").repartition(3)
    mined = urls.mine(df, min_count=4)
    found = mined.collect()
    baskets = [(frozenset(r["t"]), r["blocked"]) for r in df.orderBy("page_id").select("blocked", urls.tokens(F.col("url")).alias("t")).collect()]
    base = sum(b for _, b in baskets) / len(baskets)
    columns = {}
    for t in sorted(set().union(*(s for s, _ in baskets))):
        columns.setdefault(frozenset(i for i, (s, _) in enumerate(baskets) if t in s), []).append(t)  # tokens that always stand together are one
    hits = frozenset(i for i, (_, b) in enumerate(baskets) if b)
    least = max(4, math.ceil(urls.MIN_SUPPORT * len(rows)))
    want = []
    for n in (1, 2, 3):
        for c in itertools.combinations([(at, tuple(ts)) for at, ts in columns.items() if len(at & hits) >= least], n):
            at = frozenset.intersection(*(x for x, _ in c))
            if len(at & hits) >= least and says_something(len(at & hits), len(at), base):
                want.append((at, {ts for _, ts in c}))
    assert len(want) > 1 and any(len(c) == 2 for _, c in want)
    everything = {tuple(map(tuple, r["antecedent"])): r for r in found}
    share = lambda at: len(at & hits) / len(at)
    for at, c in want:  # each is a rule, or a simpler rule with all its items and no less confidence is
        assert any(set(d) <= c and r["confidence"] >= share(at) - 1e-12 or (len(d) == 1 and set(d) <= c) for d, r in everything.items()), c
    for d, r in everything.items():
        at = frozenset(i for i, (s, _) in enumerate(baskets) if all(set(alike) & s for alike in d))
        assert (r["n"], round(r["confidence"] * r["n"])) == (len(at), len(at & hits)) and says_something(len(at & hits), len(at), base)
        assert len(d) < 7 and not any(t.startswith("h:all") for alike in d for t in alike)
    blocked = set().union(*(at for at, _ in want))
    longer = set().union(set(), *(frozenset(i for i, (s, _) in enumerate(baskets) if all(set(a) & s for a in d)) for d in everything if len(d) > 3))
    got = {r["page_id"] for r in urls.judge(df, mined).collect() if r["verdict"] == "block"}
    assert got == blocked | longer


def documents(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 90))), rng.choice(["b", "a", "c", "Z", None, "b", "b"]), 1.0, 2) for i in range(n)]
    rows += [(n, None, "a", 1.0, 2), (n + 1, " \n", "only empty", 1.0, 2), (n + 2, "x", "tiny", 1.0, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target double, row int").repartition(3)


def water(sizes, weights, total):
    full = set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        left = sum(w for s, w in weights.items() if s not in full)
        targets = {s: 2 * sizes[s] if s in full else rest * w / left for s, w in weights.items()}
        over = {s for s in targets if s not in full and targets[s] > 2 * sizes[s]}
        if not over:
            return targets
        full |= over


def test_mixing(spark):
    rows, df = documents(spark)
    kept, spans = mixing.mix(df, block=8, slots=64)
    first = sorted(map(tuple, spans.collect()), key=str)
    got = kept.collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken, by_source = Counter(), Counter()
    for s in spans.collect():
        taken[s["doc_id"]] += s["n_words"]
        by_source[s["source"]] += s["n_words"]
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert taken[r["doc_id"]] <= 2 * r["size"]
    for s in names:
        assert abs(by_source[s] - want[s]) <= max(60, 0.06 * want[s]), (s, by_source[s], want[s])
    again = mixing.mix(df.repartition(5), block=8, slots=64)[1]
    at = lambda rows: sorted(((r["shard"], r["slot"], r["doc_id"], r["first_word"], r["n_words"]) for r in rows))
    assert at(again.collect()) == at(spans.collect()) and first
    texts = mixing.mixed_texts(df, spans).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(taken.values())
    whole = {r[0]: r[1] for r in rows}
    assert all(r["text"] in whole[r["doc_id"]] for r in texts)


def test_small_sources_get_their_targets(spark):
    sizes = {"hot": 40_000} | {f"s{i:02}": n for i, n in enumerate([130, 30, 1, 127, 128, 129, 257, 383, 2, 31] * 4)}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for block in (128, 256):
        kept, spans = mixing.mix(df, block=block, slots=32)
        taken = Counter()
        for s in spans.collect():
            taken[s["source"]] += s["n_words"]
        want = {r["source"]: r["target"] for r in kept.collect()}
        assert all(want[s] == 2 * n for s, n in sizes.items() if s != "hot")
        assert {s: taken[s] for s in sizes if s != "hot"} == {s: 2 * n for s, n in sizes.items() if s != "hot"}
        assert abs(taken["hot"] - want["hot"]) <= 2 * block


def test_draws_have_exact_totals_and_multinomial_shards(spark):
    sizes = [100_000, 130, 30, 5000, 700, 0, *[900 + 7 * i for i in range(40)]]
    targets = [90_000.0, 195.0, 60.0, 4000.5, 1399.0, 0.0, *[1.3 * n for n in sizes[6:]]]
    plan = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(sizes, targets, strict=True))], "source_no long, source_size long, target double")
    got = sorted(mixing.draws(plan, block=128, slots=16).collect(), key=lambda r: (r["shard"], r["source_no"]))
    shards, totals = Counter(), Counter()
    for r in got:
        assert r["first"] == totals[r["source_no"]] and r["n"] > 0
        shards[r["shard"]] += r["n"]
        totals[r["source_no"]] += r["n"]
    assert all(shards[i] == 16 for i in range(len(shards) - 1)) and 0 < shards[len(shards) - 1] <= 16
    for i, (n, t) in enumerate(zip(sizes, targets, strict=True)):
        want = t * -(-n // 128) / max(n, 1)
        assert abs(totals[i] - want) < 1
    # Counts vary as draws without replacement do: standardised, they have mean 0 and variance 1.
    every, n_shards = sum(totals.values()), len(shards)
    share = totals[0] / every
    deviation = (16 * share * (1 - share) * (every - 16) / (every - 1)) ** 0.5
    z = [(r["n"] - 16 * share) / deviation for r in got if r["source_no"] == 0 and r["shard"] < n_shards - 1]
    assert len(z) > 60 and abs(sum(z) / len(z)) < 0.2 and 0.5 < sum(x * x for x in z) / len(z) < 1.7
    for r in got:  # what came before stays near its share
        share = totals[r["source_no"]] / every
        assert abs(r["first"] - share * 16 * r["shard"]) < 1 + 5 * (16 * r["shard"] * share) ** 0.5


def test_large_draws_are_proportional():
    import numpy as np

    counts = np.array([3 * 10**10, 7, 10**9, 0, 2 * 10**9 + 1])
    seen = np.zeros(5, dtype=np.int64)
    left = mixing.drawn(counts, 10**10, [1])
    assert left.sum() == 10**10 and (left <= counts).all() and (abs(left - counts * (10**10 / counts.sum())) < 1).all()
    shards = -(-int(counts.sum()) // 4096)
    for shard in (0, 1, 2, shards - 1):
        first, n = mixing.shard_counts(counts, shard, 4096, 5)
        assert n.sum() == (4096 if shard < shards - 1 else int(counts.sum()) - 4096 * (shards - 1)) and (first + n <= counts).all()
        if shard < 3:
            assert (first == seen).all()
            seen += n


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    import numpy as np

    out = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(out.tolist()) == list(range(n))
    if n == 1000:
        assert out.tolist() != mixing.permuted(np.arange(n), n, 54321).tolist() and (out == np.arange(n)).mean() < 0.05


def test_mixing_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    kept, spans = mixing.mix(none)
    assert kept.count() == 0 and spans.count() == 0 and mixing.mixed_texts(none, spans).count() == 0


def test_pipeline_keeps_rows_with_null_or_repeated_ids(spark):
    import corpus_pipeline as p

    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("c", 700)), (None, text("a")), (7, text("d")), (7, text("e", 600)), (7, text("d")), (9, text("f")), (3, text("f")), (None, text("f")), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int")
    df = df.withColumn("_", F.lit("under")).withColumn("a.b", F.lit(2)).repartition(3)
    kept = p.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:1], len(r["text"] or "")) for r in kept.collect()), key=str)
    want = [(None, text("a")), (None, text("b")), (None, text("c", 700)), (7, text("d")), (7, text("e", 600)), (3, text("f")), (5, "")]
    assert got == sorted(((i, t[:1], len(t)) for i, t in want), key=str)
    kept = common.stored(kept, "kept")
    mixed = p.mix_sources(spark, kept, "")
    assert mixed.columns == df.columns
    whole = {r["row"]: r for r in kept.collect()}
    words = Counter()
    for r in mixed.collect():
        own = whole[r["row"]]
        assert r["text"] in own["text"] and (r["doc_id"], r["source"], r["n_chars"]) == (own["doc_id"], own["source"], len(r["text"]))
        words[r["row"]] += len(r["text"].split())
    rows = common.numbered(kept, "rows")
    sizes, spans = mixing.mix(rows, block=p.BLOCK)
    assert sum(words.values()) == spans.agg({"n_words": "sum"}).first()[0]
    full = {r["source"] for r in sizes.collect() if r["target"] == 2 * r["source_size"]}
    assert all(words[k] == 2 * len(r["text"].split()) for k, r in whole.items() if r["text"] and r["source"] in full)
    with pytest.raises(ValueError, match="null or repeated"):
        mixing.mixed_texts(kept, spans)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(4)
    plain = {"en": [f"the{i}ing" for i in range(80)], "de": [f"sch{i}keit" for i in range(80)]}
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(plain[lang]) for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            words[3:3] = ["vilex", "nastyo", "vilex"]
        rows.append([i, " ".join(words), lang, f"src{i % 4}", 0, 0.25])
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [[1000, rows[1][1], "en", "src1", 0, 0.25], [1001, rows[1][1] + " more", "en", "src1", 0, 0.25], [1002, None, None, None, None, None], [1003, "12 34", "en", "src1", 5, 0.25]]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    assert not ids["toxicity"] & {i for i in range(240) if i % 5 == 0} and len(ids["toxicity"]) >= 190
    assert not ids["language_id"] & {1002, 1003} and len(ids["language_id"]) >= 188
    assert 1 in ids["ngram_jaccard"] and not ids["ngram_jaccard"] & {1000, 1001} and len(ids["ngram_jaccard"]) >= 185
    words = lambda d: sum(len(r["text"].split()) for r in d.collect())
    assert abs(words(seen["mixing"]) / words(seen["ngram_jaccard"]) - 1.5) < 0.1
    assert seen["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
