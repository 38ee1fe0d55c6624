"""Each operator against a brute-force version, a library or held-out rows, on small fixtures with nulls, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sectorlens.llm import bpe, dart_minhash, decontam, imatch, langid, prefix_counts, substring_dedup, suffix_dedup, tag_paths, url_filter
from sectorlens.llm.queries import RULES, tokenizer

EDGE = [(None, "the null id"), (None, None), (900, ""), (901, None), (902, "!!! ..."), (903, "É́ ﬁ 日本語 <|endoftext|> Hello  World's 12"), (904, "a " * 90), (905, "x" * 3000), (906, "a a b " * 40)]
VOCAB = ["a", "B", "c", "dd", "é", "ffff", "Dé"]


def texts(seed, n=50, most=60):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(VOCAB) for _ in range(r.randrange(0, most)))) for i in range(n)]
    rows += [(200 + i, f"{rows[i % 7][1]} x {rows[i * 3 % 11][1]}") for i in range(15)]
    return [*rows, *EDGE, (3, rows[3][1]), (3, rows[3][1]), (4, rows[3][1] + " tail")]


def frame(spark, rows):
    """With columns whose names clash with those that operators add."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as k1", "1 as spans", "2 as ids", "'c' as key")


def empty(spark):
    return frame(spark, []).limit(0)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    rows = texts(1) + [(1000 + i, "".join(chr(r.randrange(1, 0x2FFF)) if r.random() < 0.3 else r.choice("abc thing's 12é") for _ in range(60))) for i in range(200)]
    rows = [(i, t) for i, t in rows if t is None or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = bpe.encode(frame(spark, rows), path, decoded="decoded").collect()
    assert len(got) == len(rows)
    for x in got:
        want = library.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == want and x.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame(spark, rows), path), path).where("decoded is null").count() == 0
    assert bpe.encode(empty(spark), path).count() == 0


def test_prefix_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = prefix_counts.load(path)
    for text in ["", "a", "  a  b ", "<s>x</s>", "\n\n", "ⅧⅧ", "\0", "▁▁a", " " * 40, "thing, and. so!"]:
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert list(counter.prefixes(text)) == want
        for budget in (0, 1, 3):
            assert counter.cut(text, budget) == max(i for i, n in enumerate(want) if n <= budget)
    rows = texts(2)
    for x in prefix_counts.token_counts(frame(spark, rows), path, budget=5, prefixes="counts").collect():
        assert x.n_tokens == len(library.encode(x.text or "")) == x.counts[-1] and len(x.counts) == len(x.text or "") + 1
    assert prefix_counts.token_counts(empty(spark), path).count() == 0


def test_language_on_held_out_rows(spark):
    r = random.Random(3)
    syllables = {"xx": ["th", "er", "an", "ing"], "yy": ["zu", "kli", "mo", "pra"]}
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(30)), lang) for i in range(400) for lang, s in [list(syllables.items())[i % 2]]]
    rows += [(None, None, "xx"), (800, "", None), (801, "123 !!", "yy"), (802, "the anther", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.identify(docs.withColumn("held", langid.held_out()), model).collect()
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if not x.text or not any(c.isalpha() for c in x.text))
    held = [x for x in got if x.held and x.lang and x.doc_id < 400]
    assert held and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.98 and all(0 <= x.score <= 1 for x in got)
    none = langid.identify(docs, langid.learn(docs.limit(0)))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    for copied in ("one", "two", "three", "four"):
        rows = [(copied, "xx")] * 1000 + [(f"text {i}", "xx") for i in range(2000)] + [(f"other {i % 50}", "yy") for i in range(300)] + [(copied, "yy")]
        got = [(x.text, x.lang) for x in langid.sample(spark.createDataFrame(rows, "text string, lang string"), 200).collect()]
        assert len(set(got)) == len(got) and Counter(lang for _, lang in got) == {"xx": 200, "yy": 51}


LOW = str.maketrans(decontam.UPPER, decontam.LOWER)


def test_contamination_by_brute_force(spark):
    find = lambda t: re.findall("[^\0-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    r = random.Random(4)
    items = [(i, " ".join(r.choice(VOCAB) for _ in range(r.randrange(0, 25)))) for i in range(25)] + [(99, None), (98, ""), (1, "dup item")]
    rows = texts(4) + [(300 + i, f"q {t or ''} zz ÀÉ") for i, t in items]
    windows = {}
    for i, t in items:
        w = find(t)
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + min(10, len(w))]), set()).add(str(i))
    want = []
    for d, t in rows:
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    found |= x
                    hit |= set(range(s, s + n))
        want.append((d, len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1000, 0):
        got = decontam.contamination(frame(spark, rows), bench, broadcast_rows=most).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in got), key=str) == sorted(want, key=str)
    assert decontam.contamination(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_word_windows_by_brute_force(spark):
    rows = texts(5)
    words = [(t or "").encode().split() for _, t in rows]
    for n in (7, 5):
        seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
        want = []
        for (d, _), w in zip(rows, words, strict=True):
            hit = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
            want.append((d, len(w), len(hit), b" ".join(x for i, x in enumerate(w) if i not in hit).decode()))
        got = substring_dedup.remove_repeats(frame(spark, rows), length=n).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got), key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_byte_strings_by_brute_force(spark):
    rows = [(d, t[:400] if t else t) for d, t in texts(6)]
    order = lambda d: -(2**63) if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(order(d), first.get(b[i : i + 50], 2**63))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        hit = {j for i in range(len(b) - 49) if first[b[i : i + 50]] < order(d) for j in range(i, i + 50)}
        want.append((d, len(b), len(hit), sum(i in hit and i - 1 not in hit for i in range(len(b))), bytes(x for i, x in enumerate(b) if i not in hit)))
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    a = r.integers(1, 2**63, 300, dtype=np.uint64)
    wa, wb = r.uniform(0.2, 3, 300), r.uniform(0.2, 3, 300)
    s = dart_minhash.signatures([(a, wa), (a, wb), (a, wa)], 2000)
    assert (s[0] == s[2]).all() and (s[0] == s[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.05)


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(20, 120)))) for i in range(40)]
    for i in range(60):
        w = r.choice(rows[:40])[1].split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "edit"
        rows.append((100 + i, " ".join(w)))
    rows += [*EDGE, (990, "One two"), (991, "one, two")]

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None

    known = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in known}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    got = dart_minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.class_id == (None if x.doc_id is None else top(x.doc_id)) for x in got)
    assert dart_minhash.near_duplicates(empty(spark)).count() == 0


def test_fingerprints_and_edits(spark):
    rows = [(d, t) for d, t in texts(8) if d is not None]
    rows = list(dict(rows).items())
    docs = frame(spark, rows)
    known = imatch.lexicon(docs)
    got = sorted(imatch.with_next(docs, known).collect(), key=lambda x: x.doc_id)
    rows = sorted((d, t or "") for d, t in rows)
    assert [x.doc_id for x in got] == [d for d, _ in rows]
    same = {}
    for i, (x, (_, t)) in enumerate(zip(got, rows, strict=True)):
        n, following = len(t) // 4, rows[(i + 1) % len(rows)][1]
        changed = t[: len(t) - n] + following[:n]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        assert same.setdefault(t, x.fingerprint) == x.fingerprint
    assert imatch.with_next(frame(spark, [(1, "one")]), known).count() == 1
    assert imatch.with_next(empty(spark), known).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, really.</div><div id=content><h2>Title &amp; more</h2><p>One, two, three.
 Four<br>five.<p><b>Six, seven.<p>Eight &lt; nine.<ul><li>a b, c.</ul></div><aside>Beside, here.</aside><div class="comments"><p>Nice, good. Yes, really.</p></div><form>x <input></form><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\n\nOne, two, three. Four five.\n\nSix, seven.\n\nEight < nine.\n\na b, c."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>"), (5, "u", "just text"), (6, "u", "<article><p>a<script>x")], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in tag_paths.extract(pages).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "", 5: "just text", 6: "a"}
    assert tag_paths.extract(pages.limit(0)).count() == 0


def test_main_text_of_several_containers():
    a, b, c = (f"{x} one, two, three. Four, five, six. Seven, eight, nine." for x in ("First", "Second part is longer, so it is", "Third"))
    split = f"<body><nav><p>{a}</p></nav><div id=content><div class=part><p>{a}</div><div class=part><p>{b}</div><section><p>{c}</section></div></body>"
    assert tag_paths.main_blocks(split) == [a, b, c]
    assert tag_paths.main_blocks(f"<div><p>{a}</p><blockquote><p>{b} {b}</p></blockquote><p>{c}</p></div>") == [a, f"{b} {b}", c]
    assert tag_paths.main_blocks(f"<body><article><p>{a}</article><article><p>{b}</article></body>") == [a, b]
    assert tag_paths.main_blocks(f"<body><main><h1>Title</h1><article><p>{b}</article></main></body>") == ["Title", b]
    assert tag_paths.main_blocks(f"<body><div><p>{a}<ul><li><a href=/>a source</a></ul><p>{b}</div></body>") == [a, "a source", b]


def test_ratios_decide_without_telling_names(monkeypatch):
    a, b, c = (f"{x} one, two, three. Four, five, six. Seven, eight, nine." for x in ("First", "Second part is longer, so it is", "Third"))
    links = "".join(f"<li><a href=/{i}>Place {i}</a></li>" for i in range(6))
    plain = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2><p>{a}</p><p>{b}</p><ul><li>one thing</li></ul></div><div><span>All rights kept</span></div></body>"
    article = f"<body><article><ul>{links}</ul><h1>Title</h1><p>{a}</p><p><a href=/s>a source</a></p><p>{b}</p><ol><li>one thing</ol><div><a href=/x>Send</a> <a href=/y>Print</a></div></article></body>"
    want = (["Title", a, b, "one thing"], ["Title", a, "a source", b, "one thing"])
    assert (tag_paths.main_blocks(plain), tag_paths.main_blocks(article)) == want
    monkeypatch.setattr(tag_paths, "path_ratios", lambda page: {x.element.path: 1.0 for x in page})
    got = (tag_paths.main_blocks(plain), tag_paths.main_blocks(article))
    assert got[0] != want[0] and got[1] != want[1] and set(want[0]) < set(got[0]) and set(want[1]) < set(got[1])


def test_broken_pages_take_linear_time():
    import time

    for piece in ("<div>x", "<a ", "<svg>", "<i><b>", "<p>x", "<li><a href='", "<!", "<ul><li>y", "</i>", "<b>", "<table><tr><td>z", "<script", '<a "'):
        took = []
        for n in (1, 4):
            began = time.process_time()
            tag_paths.main_blocks(("<i><div>" if piece == "</i>" else "") + piece * (n * 100_000 // len(piece)))
            took.append(time.process_time() - began)
        assert took[1] < 12 * max(took[0], 0.05), piece


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://com/en/", "x://example.net/de/81", "x://m.example.net/de/9", "http://notcom/en/", "http://a.org/es/x", "http://a.org?/es/", "http://win-casino.example/adult/xxx", "ftp://h#x://y/z"]
    rows = [(i, u) for i, u in enumerate(urls)]
    model = url_filter.learn(spark)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'r' as rule"), RULES, model).collect()
    for x in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", x.url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (x.host, x.path, x.rule) == (host, path, best.name if best else None)
        assert x.verdict == (best.verdict if best else "block" if x.score >= 0.5 else "allow")
    labelled = spark.createDataFrame(url_filter.LABELLED, "url string, y int")
    assert url_filter.judge(labelled, (), model).where("(verdict = 'block') <> (y = 1)").count() == 0
