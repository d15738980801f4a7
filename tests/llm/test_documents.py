"""Operators on single documents and pages against brute force and fixtures."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from arealis.llm import cotraining, decontaminate, disclosure, host_rules, html_text, length_histogram, packing, tokens, url_filter  # noqa: E402

ROWS = [(1, None, None), (2, "", "s"), (None, "a b", None), (3, "Word " * 60, "s"), (3, "Word " * 60, "s"), (4, "é \u3000 x\n\nx\n \nx" * 9, "t"), (5, "w" * 200_000, "t")]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns with names that operators use."""
    rows = [(d, t, s, "en", None, "x") for d, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, host string").repartition(2)


def test_decontamination(spark, odd):
    rng = random.Random(4)
    vocabulary = ["a", "B", "cc", "é", "7", "d-e", "f_g"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 13, 15, 30]))) for i in range(12)] + [(12, None)]
    docs = [(i, text(rng.randint(0, 60)) + ". " + rng.choice(items[:12])[1] + ", " + text(5)) for i in range(150)] + [(200, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for most in (8_000_000, 150):  # one automaton, and blocks
        got = {r.doc_id: r for r in decontaminate.contamination(df, bench, max_chars=most).collect()}
        clean = {r.doc_id for r in decontaminate.decontaminate(df, bench, max_chars=most).collect()}
        for d, t in docs:
            n, hit, found = brute.contamination(t, items)
            assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (n, hit, found)
            assert (d in clean) == (not (hit and 20 * hit >= n))
            assert sum(len(decontaminate.words(t[x.start:x.end].encode())) for x in got[d].spans) == hit if t else not got[d].spans
    for r in decontaminate.report(df, bench).collect():
        assert r.items_sha256 == hashlib.sha256(",".join(brute.contamination(dict(docs)[r.doc_id], items)[2]).encode()).hexdigest()
    none = decontaminate.decontaminate(odd, bench.limit(0))
    assert none.columns == odd.columns and none.count() == len(ROWS)


def test_items_without_an_id_hit(spark):
    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(None, item), (1, "one two three"), (None, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"a {item} b"), (2, "x one two three"), (3, "clean")], "doc_id long, text string")
    for most in (8_000_000, 40):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench, max_chars=most).collect()}
        assert got == {1: (14, []), 2: (3, ["1"]), 3: (0, [])}
        assert [r.doc_id for r in decontaminate.decontaminate(df, bench, max_chars=most).collect()] == [3]


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["a  b", "  x ", "\n\nA\n \n", "it's  'S don't", "²³ ¼x", "日本 語  x’s", "<|endoftext|> a", "\x1c\x1da", "\xa0\xa0a\x85", "a" * 3000, "ab\0c", " \t\n", "one\u2003two\u2003\u2003three"]
    texts += ["".join(rng.choice(" \t\n\r'sStre0129²¼éÿ×.,-_\x1c\xa0\x85ab") for _ in range(100)) for _ in range(200)]
    texts += ["".join(rng.choice(["the ", "of,", "\n", "é", "12", ". ", "日"]) for _ in range(100)) for _ in range(100)]
    for t, ids in zip(texts, tokens.encoder(tokens.vocabulary_path())(texts), strict=True):
        assert tok.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_added_token_inside_texts(spark):
    """Against the library as it comes: ids, lengths and packed pieces of texts that hold the added token's string."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, x = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    rng = random.Random(15)
    texts = [x, f"a {x} b", x + x, f"{x}a", f"a  {x}  b", f"it{x}'s", f"<{x}>", "<|endoftext|", x.upper(), f"a\n\n{x}\n", None, "", "plain"]
    texts += ["".join(rng.choice(["the ", "  ", "\n", "'s", "é", "12", x]) for _ in range(40)) for _ in range(100)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[1] == [64, 220, 50256, 275]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens.text_encoder(tokens.vocabulary_path())(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.n_tokens for r in length_histogram.token_counts(df).collect()} == {i: len(w) for i, w in enumerate(want)}
    for r in packing.pack(df, size=16, with_ids=True).collect():
        assert r.ids == [*want[r.doc_id], 0][r.start:r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def _lengths(texts):
    return [len(x) // 4 for x in tokens.encoder(tokens.vocabulary_path())(texts)]


def test_packing(spark, odd):
    got = packing.pack(odd, size=64, with_ids=True).collect()
    want = sorted(n for x in _lengths([t for _, t, _ in ROWS]) for _, n in packing.cuts(x + 1, 64))
    assert sorted(r.length for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(odd.limit(0)).count() == 0


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]


def test_supersteps_are_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        size = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
        ranges, n = packing.supersteps({x: lengths.count(x) for x in lengths}, size)
        gaps = []
        for x in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - x)
            else:
                gaps.append(size - x)
        assert n <= len(gaps)
        assert n >= -(-sum(lengths) // size)
        del ranges


def test_length_histogram(spark, odd):
    sums = length_histogram.with_suffix_sums(length_histogram.histogram(length_histogram.token_counts(odd)), block=4)
    lengths = _lengths([t for _, t, _ in ROWS])
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.n_tokens) and r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
    for r in length_histogram.at_limits(sums, [0, 1, 50, 61, 10_000_000]).collect():
        assert (r.docs_longer, r.truncated_tokens) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    for r in length_histogram.quantiles(sums, [0.0, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    assert length_histogram.with_suffix_sums(length_histogram.histogram(length_histogram.token_counts(odd.limit(0)))).count() == 0


def test_url_filter(spark):
    urls = [None, "no scheme", "http://", "https://A.B.com/en/x?y", "http://www.b.com", "ftp://b.com/en/", "x://spam.org#f", "http://notspam.org/a/b", "http://deep.spam.org/a?b#c", "http://b.com/private/x", "http://b.com/private/x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, urls[3], "r")], "page_id long, url string, rule string").repartition(2)
    rules = spark.createDataFrame([("com/", "allow"), ("b.com/en/", "block"), ("b.com/priv", "block"), ("a.b.com/en/", "allow"), (None, "block")], "rule string, verdict string")
    listed = spark.createDataFrame([("spam.org",), ("notspam.org/a/",), (None,)], "entry string")
    got = [sorted(map(tuple, url_filter.filter_urls(pages, rules, listed, max_entries=m).collect()), key=str) for m in (100, 1)]
    assert got[0] == got[1]
    by = {r[0]: r[1:] for r in got[0]}
    assert by[0] == by[1] == ("", "", None, "allow")
    assert by[3] == by[None] == ("a.b.com", "/en/x", "a.b.com/en/", "allow")
    assert by[4] == ("www.b.com", "", None, "allow") and by[5] == ("b.com", "/en/", "b.com/en/", "block")
    assert by[6] == ("spam.org", "", None, "block") and by[7][3] == "block" and by[8] == ("deep.spam.org", "/a", None, "block")
    assert by[9] == by[10] == ("b.com", "/private/x", "b.com/priv", "block") and by[11] == ("b:", "", None, "allow") or by[11][0] == "b:"
    empty = url_filter.filter_urls(pages, rules.limit(0), None)
    assert {r.verdict for r in empty.collect()} == {"allow"}


def test_digest_array_confirms_strings():
    entries = [(f"e{i}.org", 4) for i in range(500)]
    array = url_filter.DigestArray(url_filter.array_bytes(entries))
    assert array.lookup(["e7.org", "e500.org", ""]) == [4, 0, 0]
    array.keys = np.full(500, array.keys[0])  # all keys alike: only the strings tell them apart
    found = [i for i in range(500) if array.text[array.ends[i]:array.ends[i + 1]].tobytes() == b"e7.org"]
    assert len(found) == 1


def test_host_rules(spark, odd):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "bb", "#c", "d\n", "d\nd\n", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, rng.choice(["x", "y", None])) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    for r in host_rules.judge(docs).collect():
        own = brute.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (r.base_failed and r.kept)
    kept = host_rules.quality_filter(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set()
    assert host_rules.judge(odd).count() == len(ROWS) and host_rules.judge(odd.limit(0)).count() == 0


def test_clean_documents_survive_a_bad_host(spark):
    clean = [" ".join(f"word{i}x{j}" for j in range(80)) for i in range(3)]
    bad = ["%% && ** ## $$ " * 3 + " ".join(f"w{i}y{j} &&&&&&&" for j in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "bad") for i, t in enumerate(clean + bad)] + [(100 + i, c + " z", "good") for i, c in enumerate(clean * 20)], "doc_id long, text string, source string")
    by = {r.doc_id: r.kept for r in host_rules.judge(docs).collect()}
    assert all(by[i] for i in range(3)) and not any(by[i] for i in range(3, 43)) and by[100]


def test_only_rejected_rows_go(spark):
    """Rows are told apart by id, text and host; a null id or a repeated one loses nothing else."""
    clean = [" ".join(f"word{i}x{j}" for j in range(80)) for i in range(4)]
    soft = "%% && ** ## $$ " * 3 + " ".join(f"w{j} &&&&&&&" for j in range(60))
    rows = [(None, clean[0], "g", "a"), (None, "too short", "g", "b"), (None, None, "g", "c"), (7, clean[1], "g", "d"), (7, "too short", "g", "e"),
            (7, clean[1], "g", "f"), (8, clean[2], None, "g"), (8, "", None, "h"), (9, soft, "good", "i"), (9, soft, "bad", "j")]
    rows += [(100 + i, soft + f" q{i}", "bad", "k") for i in range(40)] + [(200 + i, clean[3] + f" q{i}", "good", "l") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag string").repartition(3)
    assert sorted(r.tag for r in host_rules.quality_filter(docs).collect()) == ["a", "d", "f", "g", "i"] + ["l"] * 40


def test_base_spans(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x.y@z-1.co.uk", "_x@c.org", "é", "1.2.3.4", "256.1.1.1", "001.02.3.4", ".5.6", "4111 1111 1111 1111", "4111-1111-1111-1111", "5  7", "1 2 3", "+1 (555) 123-4567",
             "+49 30 1234567", "+1", "(((", "-", " ", ".", "\n", "@", "%", "日本", "12 ", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["1" * 20_000, "1 " * 20_000, "a." * 9000 + "@" + "a." * 9000 + "b", "+" + "1(" * 20_000, "1.2.3." * 9000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in disclosure.base_spans(df).select("doc_id", *disclosure.KINDS).collect():
        assert {k: [tuple(x) for x in r[k]] for k in disclosure.KINDS} == brute.personal(texts[r.doc_id])


def test_disclosing_terms(spark):
    rng = random.Random(9)
    names, docs = ["Zarkonian", "Belthazar"], []
    for i in range(300):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "the", "with"]) for _ in range(rng.randint(5, 40))]
        if i % 20 == 0:
            j, at = rng.randrange(2), rng.randrange(len(w))
            w[at:at] = [names[j], f"user{j}@mail.com"]
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, docs[20][1]) for i in range(20)] + [(None, docs[0][1]), (5000, None), (5001, "Zarkonian alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = disclosure.report(df).collect()
    assert len(rows) == len(docs)
    for r, t in ((r, dict(docs)[r.doc_id]) for r in rows if r.doc_id is not None):
        base = brute.personal(t)
        assert r.n_email == len(base["email"])
        own = ",".join(f"{k}:{a}:{b}" for k in disclosure.KINDS for a, b, _ in base[k])
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and r.spans.startswith(own)
        assert r.n_terms == (sum((t or "").count(n) for n in names) if base["email"] else 0)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert "Zarkonian" not in clean[0] and "@" not in clean[0] and "[EMAIL]" in clean[0] and clean[1] == docs[1][1] and clean[5000] is None
    assert disclosure.report(df.limit(0)).count() == 0


def test_terms_far_from_a_mention(spark):
    """A name at the top of long documents counts although the address stands at their end, in all of them or in some."""
    rng = random.Random(19)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(100))
    docs = [(i, f"Quorvane {filler()} far@mail.com far2@mail.com") for i in range(4)]
    docs += [(10 + i, f"{filler()} Mixtavel {filler() if i else ''} some@mail.com") for i in range(4)] + [(300 + i, filler()) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: {x.value for x in r.terms} for r in disclosure.spans(df).collect()}
    assert all(got[i] == {"Quorvane"} and got[10 + i] == {"Mixtavel"} for i in range(4))
    assert not any(got[300 + i] for i in range(150))


LONG = "This sentence belongs to the page, as many others do. "


@pytest.fixture(scope="module")
def model():
    return html_text.fit([html_text.parse(x) for x in html_text.EXAMPLES])


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("only words", "only words"), ("a &lt; b &amp;&#233;", "a < b &é"),
    (f"<article><h1>T  x</h1><p><b>{LONG}<br><p>Two\n words.</p></article><footer>no {LONG}</footer>", f"T x\n\n{LONG.strip()}\n\nTwo words."),
    (f"<nav><a href=x>Home</a></nav><div class='content'><p>{LONG}</p><form>{LONG}</form><script>if(a<b)'</p>'</script><!-- {LONG} --></div><div class='sidebar'><p>{LONG}</p></div>", LONG.strip()),
    (f"<body><article><p>{LONG}</p><aside>{LONG}</aside><div class='comments'><p>{LONG}</p></div></article><div id='cookie-notice'>{LONG}</div>", LONG.strip()),
    (f"<header>Site</header><main><p>{LONG}</p><div class='ad'>Buy.</div><ul><li>one<li>two</ul></main>", f"{LONG.strip()}\n\none\n\ntwo"),
])
def test_main_text(model, page, want):
    assert html_text.main_text(page, model) == want


def test_marginals_are_exact(model):
    """Against the sum over all labellings of small trees."""
    from itertools import product

    nodes = html_text.parse(f"<div><p>{LONG}</p><div class='ad'><p>x</p></div></div>")
    own = np.zeros((len(nodes), 2))
    own[:, 1] = html_text.features(nodes) @ model.weights
    total, on = 0.0, np.zeros(len(nodes))
    for y in product((0, 1), repeat=len(nodes)):
        score = np.exp(sum(own[i, v] for i, v in enumerate(y)) + sum(model.edges[html_text.edge_kind(nodes, i), y[nodes[i].parent], y[i]] for i in range(1, len(nodes))))
        total += score
        on += score * np.array(y)
    assert np.allclose(on / total, model.marginals(nodes))


def test_extract(spark, model):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", 1), (None, None, None, 1), (2, "v", "<p>" * 3000 + "x", 1), (2, "v", "<a" * 20_000, 1)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages)
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect())[:2] == [(0, 0), (1, len(LONG) - 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_cotraining(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    got = cotraining.classify(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").select("score", "label", "quality").collect()
    assert len(got) > 100 and np.mean([r.label == r.quality for r in got]) > 0.95
    assert {r.score for r in cotraining.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert cotraining.classify(odd, labels).count() == len(ROWS) and cotraining.classify(odd.limit(0), labels).count() == 0
