"""Plain versions of fingerprints, URL scores and language scores, both sides of broadcast choices, and odd tables: empty, null, repeated, long, clashing names."""

import random
import re
from collections import Counter

import pytest
import xxhash

from sectorlens.llm import bpe, dart_minhash, decontam, imatch, langid, prefix_counts, substring_dedup, suffix_dedup, tag_paths, url_filter
from sectorlens.llm.queries import tokenizer

M64 = (1 << 64) - 1


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & M64
    return x ^ x >> 33


def plain_fingerprint(text, known):
    """Sets of terms for each fixed subset, hashed."""
    t = {xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", text.lower())}
    if not t:
        return None
    t = (t & known) or t
    groups = [[frozenset(t)]]
    for level in range(1, imatch.LEVELS + 1):
        groups.append([frozenset(x for x in t if mixed(x ^ mixed(s * 0x9E3779B97F4A7C15 & M64)) < 1 << 64 - 2 * level) for s in range(1, imatch.SUBSETS + 1)])
    return groups


def plain_likeness(a, b):
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    same = of = 0
    for i, (p, q) in enumerate(zip(a[1:], b[1:], strict=True)):
        if i == imatch.LEVELS - 1 or 4 * max(sum(not x for x in p), sum(not x for x in q)) >= imatch.SUBSETS:
            for x, y in zip(p, q, strict=True):
                of += bool(x or y)
                same += bool(x or y) and x == y
    return same / of if of else 0.0


def test_fingerprints_by_a_plain_version(spark):
    r = random.Random(21)
    vocab = [f"w{int(r.expovariate(1 / 400))}" for _ in range(4000)]
    texts = {i: " ".join(r.choice(vocab) for _ in range(r.choice((0, 1, 3, 20, 200, 2000)))) for i in range(60)} | {70: None, 71: "!!", 72: "rare once only"}
    texts[73] = texts[5]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as p")
    count = Counter(w for t in texts.values() for w in set(re.findall(r"\w+", (t or "").lower())))
    low, high = 2, 12
    known = {xxhash.xxh3_64_intdigest(w) for w, n in count.items() if low <= n <= high}
    lexicon = imatch.lexicon(docs, rarest=low / len(texts), commonest=(high + 0.5) / len(texts))
    assert set(lexicon.tolist()) == known
    ids = sorted(texts)
    for x in imatch.with_next(docs, lexicon).collect():
        own, after = texts[x.doc_id] or "", texts[ids[(ids.index(x.doc_id) + 1) % len(ids)]] or ""
        n = len(own) // 4
        changed = own[: len(own) - n] + after[:n]
        a, b, c = (plain_fingerprint(t, known) for t in (own, changed, after))
        near = lambda t, u, p, q: 1.0 if t == u else plain_likeness(p, q)
        assert x.near_edited == pytest.approx(near(own, changed, a, b), abs=0.02) and x.near_next == pytest.approx(near(own, after, a, c), abs=0.02)
        for got, want in ((x.fingerprint, a), (x.edited_fingerprint, b)):
            parts = got.split(":")
            assert (want is None) == (parts[0] == "x")
            if want:
                empty = [[p[i : i + 4] == imatch.NONE for i in range(0, len(p), 4)] for p in parts[1:]]
                assert empty == [[not s for s in g] for g in want[1:]]
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e")], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in imatch.with_next(repeated, lexicon).collect()) == ["1", "1", "1", "None"]
    long = spark.createDataFrame([(i, f"w{i} " * 300_000) for i in range(12)], "doc_id long, text string")
    assert [x.n_chars for x in imatch.with_next(long, lexicon).orderBy("doc_id").collect()] == [len(f"w{i} ") * 300_000 for i in range(12)]


def test_url_scores_by_a_plain_version(spark):
    model = url_filter.learn(spark)

    def cells(text):
        chars, out = f"^{text}$", []
        for n in url_filter.SIZES:
            for i in range(len(chars) - n + 1):
                h = 42
                for c in chars[i : i + n]:
                    h = xxhash.xxh64_intdigest(c.encode(), seed=h)
                out.append((h - (h >> 63 << 64)) % url_filter.CELLS)
        return out

    import math

    urls = [u for u, _ in url_filter.LABELLED[::7]] + [None, "", "http://", "http://é.example/ü", "http://a.example/" + "long/" * 5000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as score")
    got = url_filter.judge(pages, (), model).collect()
    assert len(got) == len(urls) + 3
    for x in got:
        c = cells(x.host + x.path)
        want = 1 / (1 + math.exp(-(model.intercept + sum(model.weights[i] for i in c) / max(1, len(c)))))
        assert x.score == pytest.approx(want) and x.verdict == ("block" if x.score >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0), (), model).count() == 0
    rules = (url_filter.Rule("com", "/xyab", "allow"), url_filter.Rule("a.com", "/xy", "block"), url_filter.Rule("a.com", "/xy", "allow"))
    tied = url_filter.judge(spark.createDataFrame([("http://a.com/xyab",), ("http://a.com/xy",)], "url string"), rules, model).collect()
    assert [(x.rule, x.verdict) for x in tied] == [("com/xyab", "allow"), ("a.com/xy", "block")]


def test_url_scores_on_hosts_kept_from_learning(spark):
    assert url_filter.held_out_accuracy(spark) >= 0.85


def test_languages_by_a_plain_version(spark):
    r = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ster", "ung", "ver", "lich"], "cc": ["ção", "nha", "lhe", "mi"]}
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(r.choice((1, 5, 40)))), lang) for i in range(150) for lang, s in [list(syllables.items())[i % 3]]]
    rows += [(200, "Zzz qqq", None), (201, "", "aa"), (202, "¡!", "bb"), (203, None, None), (204, "ka lo" * 100_000, None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as score", "2 as lang_pred")

    def grams(t):
        s = re.sub("[^a-zãçº¼À-ɏ]+", " ", f" {t or ''} ".lower())
        return [s[i : i + 5] for i in range(max(1, len(s) - 4))] if s.strip() else []

    learning = {lang: {g for _, t, x in rows if x == lang for g in grams(t)} for lang in syllables}
    model = langid.learn(docs)
    got = langid.identify(docs, model, n_grams="n").collect()
    assert len(got) == len(rows)
    for x in got:
        g = grams(x.text)
        shares = {lang: sum(q in k for q in g) / len(g) if g else 0 for lang, k in learning.items()}
        best = max(sorted(shares), key=shares.get)
        assert x.n == len(g) and x.lang_pred == (best if g else "und") and x.score == pytest.approx(shares[best], abs=0.002)
    assert next(x for x in got if x.doc_id == 200).lang_pred == "aa"  # in no language: the first
    assert langid.identify(docs.limit(0), model).count() == 0


def test_both_sides_of_the_broadcast_choices(spark, monkeypatch):
    r = random.Random(4)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(30)]
    rows += [(50 + i, rows[i][1].replace("v7 ", "v8 ") + " " + rows[i + 1][1]) for i in range(10)] + [(80 + i, rows[i][1] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda: sorted((x.doc_id, x.kept_text) for x in substring_dedup.remove_repeats(docs, length=9).collect())
    near = lambda: sorted((x.doc_id, x.class_id) for x in dart_minhash.near_duplicates(docs).collect())
    before = cut(), near()
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(dart_minhash, "BROADCAST_ROWS", -1)
    assert (cut(), near()) == before and sum(a != b for a, b in before[1]) == 10


def test_texts_beyond_one_slice(spark):
    big = " ".join(f"thing{i % 977}" for i in range(900_000))
    docs = spark.createDataFrame([(1, big), (2, "small one"), (3, big)], "doc_id long, text string")
    codec = bpe.encode(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json")).selectExpr("doc_id", "size(ids) as n").collect()
    counts = prefix_counts.token_counts(docs, tokenizer("piece_bpe_32k.model")).collect()
    for found in ({x.doc_id: x.n for x in codec}, {x.doc_id: x.n_tokens for x in counts}):
        assert found[1] == found[3] > 900_000 and found[2] > 0
    kept = {x.doc_id: x.n_removed for x in suffix_dedup.remove_repeats(docs).collect()}
    assert kept == {1: 0, 2: 0, 3: len(big)}


def test_repeated_pages_and_clashing_names(spark):
    html = "<body><article><h1>T</h1><p>One, two. Three.</p></article><footer>x</footer></body>"
    pages = spark.createDataFrame([(1, html), (1, html), (None, html), (2, "<div>" * 50_000 + "deep, text."), (3, None)], "page_id long, html string").selectExpr("*", "'t' as text", "'k' as n_chars")
    got = [(x.page_id, x.text) for x in tag_paths.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "T\n\nOne, two. Three."), (1, "T\n\nOne, two. Three."), (None, "T\n\nOne, two. Three."), (2, "deep, text."), (3, "")], key=str)


def test_ids_that_are_not_numbers_have_no_order(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        suffix_dedup.remove_repeats(docs)
    with pytest.raises(ValueError, match="whole numbers"):
        dart_minhash.near_duplicates(docs)
    assert decontam.contamination(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).first().n_hit == 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "never there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]), ("one", [(1, "a few plain words in here", "en", "s", 25)] * 3)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "benchmark.parquet").symlink_to(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, str(folder)).count() == (name == "one")
