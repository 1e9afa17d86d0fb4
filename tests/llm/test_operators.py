"""Every operator against brute force, with nulls, empty texts, ties, empty tables and clashing columns."""

import hashlib
import html as entities
import io
import itertools
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (bpe, components, licenses, ngram_join, packing, pages, repeats, rules, seeds, url_filter,
                          warc, words)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (5, BASE + "\n" + BASE), (1, BASE), (2, None), (3, ""), (4, " \n\t "), (9, "x " + BASE.upper()),
    (7, BASE.replace("w30", "zz")), (8, "one two"), (8, "one two"), (10, "One two"), (None, BASE), (-3, "a\x0bb c é"),
    (11, " ".join(f"q{i % 7}" for i in range(3000))), (12, "tail " + " ".join(f"w{i}" for i in range(20, 45)) + " end"),
]
SCHEMA = "doc_id long, text string, source string, n_words string, __block string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, None if i % 5 == 0 else "s", "clash", "b") for i, (d, t) in enumerate(DOCS)],
                                 SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, fold=False):
    text = text or ""
    if fold:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


def test_words_and_windows():
    texts = [t for _, t in DOCS] + ["q" * 300 + " q"]
    (_, _, w), = words.runs(pa.array(texts))
    assert [[x.decode() for x in w.of(i)] for i in range(len(texts))] == [words_of(t) for t in texts]
    h = words.windows(words.hashes(w), 5)
    flat = [x for t in texts for x in words_of(t)]
    seen = {}
    for i in words.window_starts(w, 5):
        assert seen.setdefault(h[i], tuple(flat[i:i + 5])) == tuple(flat[i:i + 5])
    assert len(seen) == len({tuple(ws[i:i + 5]) for t in texts for ws in [words_of(t)] for i in range(len(ws) - 4)})


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_packing_blocks(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype(np.uint32)
    raw = packing.segment([None, 4, 4], [9000, 0, 1001], ids, bits)
    s = packing.Segment(pa.BufferReader(raw))
    assert s.doc_ids == [None, 4, 4] and (s.ids(4000, 8300) == ids[4000:8300]).all()
    assert (s.document(2) == ids[9000:]).all() and len(s.document(1)) == 0


def test_token_ids(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for d, text in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows(packing.round_trip(docs, path, 1)) == sorted(want, key=repr)
    assert rows(packing.round_trip(none, path, 1)) == []


def test_word_coder():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, coder = Tokenizer.from_file(path), packing.WordCoder(path)
    texts = ["", "it's  \x1c X,y", "<|endoftext|>Ab <|ENDOFTEXT|>.", "é É ́x", "ΑΣ İ ß ½ 日本12", "a\u0085b»)."]
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_coder_keeps_what_a_run_needs(monkeypatch):
    """Words at hand are not encoded again when the cache is full; a stem is kept once, as a word."""
    coder = packing.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "CACHED", 0)
    asked, plain = [], coder._stems
    monkeypatch.setattr(coder, "_stems", lambda words: asked.append(sorted(words)) or plain(words))
    got = [list(coder.encode([t])) for t in ("some words, été!", "words, some other", "some other")]
    assert asked == [sorted([b"some", b"words", b",", "été!".encode()]), [b"other"], []]
    assert set(coder.words) == {b"", b"some", b"other"}
    fresh = packing.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    assert got[1] == list(fresh.encode(["words, some other"]))


def test_substring_dedup(docs, none):
    order = sorted(((d is None, d or 0, t is None, t or ""), d, t) for d, t in DOCS)
    seen, want = set(), []
    for _, d, t in order:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            g = tuple(w[i:i + 20])
            if g in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = repeats.remove_repeats(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert got.columns == ["doc_id", "text", "source", "__block", "n_words", "n_removed", "kept_sha256"]
    assert repeats.remove_repeats(none).count() == 0


def plain_groups(items, k=5, percent=80):
    sets = {}
    for d, t in items:
        w = words_of(t, True)
        sets.setdefault(d, []).append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, ss in sets.items() for s in ss), key=repr)


def test_ngram_join(spark, docs, none):
    assert rows(ngram_join.similar_documents(docs)) == plain_groups(DOCS)
    assert ngram_join.similar_documents(none).count() == 0
    chain = [(i, " ".join(f"t{j}" if j >= 4 * i else f"u{i}_{j}" for j in range(120))) for i in range(25)]
    chain += [(100 + i, " ".join(f"c{j}" for j in range(40)) + f" z{i} " + " ".join(f"y{i}_{j}" for j in range(30)))
              for i in range(25)]
    assert rows(ngram_join.similar_documents(spark.createDataFrame(chain, "doc_id long, text string"))) == plain_groups(chain)


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(50, 50)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {50: 50}


def plain_rule(text):
    w = words_of(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_rules(spark, none):
    items = [(i, t) for i, (_, t) in enumerate(DOCS) if not t or len(t) < 2000]
    items += [(50, "a b c d a b c\nx\nx\n \n#$"), (51, "a a a a a"), (52, BASE + "\n" + "k1 k2 k3 k1 k2 k3")]
    df = spark.createDataFrame([(i, t, "h" if i % 2 else None) for i, t in items], "doc_id long, text string, source string")
    want = sorted(((i, *plain_rule(t), not plain_rule(t)[-1]) for i, t in items), key=repr)
    assert rows(rules.judge(df)) == want
    assert rows(rules.keep(df), "doc_id") == [(r[0],) for r in want if r[-1]]
    assert rules.judge(none).count() == 0 and rules.keep(none).count() == 0


def test_rejected_hosts(spark):
    judged = [("bad", True)] * 300 + [("good", False)] * 300 + [("one", True)] + [(None, True)] * 50
    got = rules.rejected_hosts(spark.createDataFrame(judged, "host string, failed boolean"), 0.9)
    assert rows(got) == [("bad",)]


def test_tags_of_odd_pages_in_linear_time():
    import random
    import time

    rnd = random.Random(6)
    plain = re.compile(
        rf"<!--.*?(?:-->|\Z)|<({pages._RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)"
        r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
        r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
    bits = ["<", ">", '"', "'", "<a ", "</p>", "<p>", "<!--", "-->", "<!x", "<script>", "</SCRIPT >", "<title", "<titles",
            " x ", "=", "/", "é", "<br/>", "<?", "</script", "--"]
    for _ in range(20000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        want = [(m.start(), m.end(), bool(m[1]), m[3] or m[6] or "", m[2] or m[5] or "", m[4] or m[7] or "")
                for m in plain.finditer(page)]
        assert list(pages._tokens(page)) == want, page
    for unit in ('<a "x ', '<a ">"', "<a '>\"", "<a ", "<script ", "<!", "<a \"x' ", "</a '>'"):
        begun = time.perf_counter()
        assert sum(1 for _ in pages._tokens((unit * (1 << 20))[:1 << 20] + "'")) >= 0
        assert time.perf_counter() - begun < 2, unit


def test_license_rows_that_share_an_id(spark):
    notice = dict((i, t) for i, (_, t) in enumerate(licenses.TEMPLATES))
    items = [(1, notice[4]), (1, "plain text"), (None, notice[0]), (None, None), (None, "nothing"), (2, notice[4]), (2, notice[4])]
    got = sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in licenses.scan(
        spark.createDataFrame(items, "doc_id long, text string")).collect())
    assert [(d, lab, s) for d, n, lab, s in got] == [
        (0, "", 0.0), (0, "", 0.0), (0, "mit", 1.0), (1, "", 0.0), (1, "bsd", 1.0), (2, "bsd", 1.0), (2, "bsd", 1.0)]


def test_license_scan(spark, none):
    long = dict((i, t) for i, (_, t) in enumerate(licenses.TEMPLATES))[0].split()
    items = [(1, "x MIT License, mit license y"), (2, None), (3, "cc by-nc cc by"), (4, " ".join(long[:9] + ["odd"] + long[9:])),
             (5, "Released under the MIT License."), (6, "the gnu general public licenses"), (7, " ".join(long[:6]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 3, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].labels, got[2].score) == (0, 0, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3)
    assert (got[4].base_labels, got[4].labels) == ("", "mit") and 0.6 <= got[4].score < 1
    assert (got[5].labels, got[5].score) == ("mit", 1.0)
    assert got[6].n_base == 0 and got[7].labels == ""
    assert licenses.scan(none).count() == 0


def test_decontamination(spark, docs, none):
    item = [f"b{i}" for i in range(30)]
    changed = [x if i % 7 else "zz" for i, x in enumerate(item)]
    items = [(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, "too short"), (5, " ".join(f"s{i}" for i in range(9)))]
    texts = [(1, "pre " + " ".join(item).upper() + " post"), (2, " ".join(changed)), (3, " ".join(item[:8])), (4, None),
             (5, "a " + " ".join(f"s{i}" for i in range(9))), (6, " ".join(item[:15]) + " " + " ".join(f"r{i}" for i in range(15)))]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(seeds.overlaps(d, b), "doc_id", "item_id", "n_matched", "first_word") == [
        (1, 1, 30, 1), (2, 1, 24, 1), (5, 5, 9, 1), (6, 1, 15, 0)]
    assert rows(seeds.decontaminate(d, b), "doc_id") == [(3,), (4,)]
    assert seeds.overlaps(none, b).count() == 0 and seeds.overlaps(docs, b.limit(0)).count() == 0


def match(item, text):
    """Best overlap of one item with one text, both lists of words."""
    items = seeds.index_items([(1, " ".join(item))])
    (_, _, w), = words.runs(pa.array([" ".join(text)]), fold=True)
    return seeds._matches(w, items, 13, 80).get((0, 0))


def changed_words(item, places):
    return [f"z{i}" if i in places else x for i, x in enumerate(item)]


def test_seeds_find_every_period_and_length():
    item = [f"b{i}" for i in range(59)]
    for size in (20, 30, 59):
        for period in range(5, 13):
            for at in range(period):
                places = set(range(at, size, period))
                if 100 * (size - len(places)) >= 80 * size:
                    assert match(item[:size], changed_words(item[:size], places)), (size, period, at)
    for size in range(1, 17):
        short = item[:size]
        for most in range(size + 1):
            if size - most < seeds.needed(size, 13, 80) or 100 * (size - most) < 80 * size:
                break
            for places in itertools.combinations(range(size), most):
                family = seeds.family_of(size, 13, 80)
                shown = "".join("0" if i in places else "1" for i in range(size))
                assert any(all(m == "0" or c == "1" for m, c in zip(mask, shown[i:])) for mask in family
                           for i in range(size - len(mask) + 1)), (size, places)
    assert match(["a", "b"], ["x", "a", "b"]) == (2, 2, 1, 2) and match(item[:12], ["z", *item[1:12]]) == (11, 12, 1, 11)


def plain_stretch(same, need, percent):
    """Best stretch by trying all: most matches over mismatches at 2, then first end, then first start."""
    best = None
    for to in range(1, len(same) + 1):
        for at in range(to):
            n = sum(same[at:to])
            if n >= need and 100 * n >= percent * (to - at):
                key = (n - 2 * (to - at - n), -to, -at)
                best = max(best or ((-10 ** 9,), ()), (key, (at, to, n)))
    return best and best[1]


def test_best_stretch():
    rng = np.random.default_rng(1)
    for i in range(1500):
        size, equal = int(rng.integers(1, 60)), rng.choice([0.6, 0.7, 0.75, 0.8, 0.85, 0.95])
        same = rng.random(size) < equal
        if i % 3 == 0:
            same[:14] = True
        need = int(rng.integers(1, 16)) if i % 2 else 13
        assert seeds._extend(same, need, 80) == plain_stretch(same.tolist(), need, 80), same


def test_overlap_beside_a_worse_stretch():
    item = [f"b{i}" for i in range(200)]
    got = match(item[:170], item[:20] + changed_words(item[20:170], set(range(0, 150, 4))))
    assert got and got[0] >= 20 and got[2] == 0 and 100 * got[0] >= 80 * (got[3] - got[2] + 1)
    rng = np.random.default_rng(2)
    for _ in range(400):  # all diagonals of small texts, few different words
        item = [f"b{x}" for x in rng.integers(0, 30, int(rng.integers(1, 40)))]
        text = [x if rng.random() < 0.8 else "z" for x in item]
        text = [f"b{x}" for x in rng.integers(0, 30, 5)] + text[int(rng.integers(0, 4)):] + [f"b{x}" for x in rng.integers(0, 30, 5)]
        need, want = seeds.needed(len(item), 13, 80), 0
        for diagonal in range(-len(item), len(text)):
            lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
            stretch = plain_stretch([item[i] == text[diagonal + i] for i in range(lo, hi)], need, 80)
            want = max(want, stretch[2] if stretch else 0)
        got = match(item, text)
        assert (got[0] if got else 0) == want


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [x or "" for _, x in DOCS] + ["a  b", " x ", "it's <|endoftext|>\n\n y", "日本 \x1c z\t q", "a" * 500, "zqxj" * 40]
    for text, (ids, n, raw) in zip(texts, bpe.vocabulary(path).encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want)
        assert raw.decode(errors="replace") == t.decode(want, skip_special_tokens=False)
    got = bpe.encode(docs, path, with_ids=True)
    assert got.count() == len(DOCS) and got.where("size(ids) <> n_tokens").isEmpty()
    assert bpe.encode(none, path).count() == 0


def test_bpe_keeps_what_a_run_needs(monkeypatch):
    """Chunks at hand are not learned again when the cache is full, and give the same ids and bytes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe.Vocabulary(path)
    monkeypatch.setattr(bpe, "CACHED", 0)
    asked, plain = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda chunks: asked.extend(chunks) or plain(chunks))
    first = list(coder.encode(["some words, été zqxj"]))
    asked.clear()
    assert list(coder.encode(["some words, été zqxj"])) == first and asked == []
    assert list(coder.encode(["some other"])) == list(bpe.vocabulary(path).encode(["some other"]))
    assert asked == [" other"] and set(coder.chunks[0]) == {"other"} == set(coder.chunks[1])


def test_bpe_keeps_what_came_again(monkeypatch):
    """A full cache drops chunks that came once, not those that runs have in common, and stays within its bound."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe.Vocabulary(path)
    monkeypatch.setattr(bpe, "CACHED", 40)
    asked, plain = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda chunks: asked.extend(chunks) or plain(chunks))
    for i in range(30):
        text = " ".join(["top", *(["often", "zqxj"] if i % 2 else []), *[f"n{i}x{j}" for j in range(10)]])
        assert list(coder.encode([text])) == list(bpe.vocabulary(path).encode([text]))
        assert len(coder.chunks[0]) + len(coder.first[0]) <= 40 + 13
    assert asked.count(" often") == 1 and asked.count(" n3x4") == 1


def test_warc(spark):
    big = "<p>" + "é" * 700
    items = [(1, "http://a", big), (2, None, big), (3, "b\r\nX: y", None), (4, "c", ""), (5, "d", "small"), (6, "e", "small"),
             (None, "f", big), (2, None, big), (7, "g", big + "x")]
    got = warc.round_trip(spark.createDataFrame(items, "page_id long, url string, html string"))
    want = []
    for p, _, h in items:
        raw = (h or "").encode()
        again = h == big and p != 2
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert rows(got) == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
        with z.open("last", "w", force_zip64=True) as f:
            f.write(b"0123456789")
    r = warc.ZipReader(pa.BufferReader(out.getvalue() ))
    assert len(r.members) == 66_001 and r.read("last", 3, 4) == b"3456"


def test_url_filter(spark):
    urls = ["http://ORG/", "https://x.org?q", "http://example.org/es/a", "http://m.example.org/en/12#x", "http://a.com/fr/",
            "http://a.com/de/1", "http://spam-x.net/", "no", None, "://spam.io", "http://myspam.net/a?b", "http://a.net#/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {
        0: ("org", "/", "org/", "allow"), 1: ("x.org", "", None, "allow"), 2: ("example.org", "/es/a", "example.org/es/", "block"),
        3: ("m.example.org", "/en/12", "example.org/en/1", "block"), 4: ("a.com", "/fr/", "com/fr/", "allow"),
        5: ("a.com", "/de/1", "com/de/", "block"), 6: ("spam-x.net", "/", None, "block"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("spam.io", "", None, "block"), 10: ("myspam.net", "/a", None, "allow"),
        11: ("a.net", "", None, "allow")}


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade(keys, F.substring("key", -1, 1) == "7")
    assert len(cascade.levels) > 1
    asked = cascade.ask(keys, "key", "listed")
    assert asked.where("listed <> (substring(key, -1, 1) = '7')").isEmpty()


PAGE = ("<html><head><title>t</title><style>p</style></head><body><header>Site</header><nav><a>menu</a></nav>{}"
        "<div class='sidebar'>side</div><form>f</form><div id=comments><article>c</article></div><footer>foot</footer></body>")


def test_main_text(spark):
    marked = PAGE.replace("{}", "<article><h1>Title &amp; x</h1><p>One <b>b</b>old<br>two<p>three<script>no</script>"
                         "<div class=ad>ad</div></article>")
    assert pages.main_text(marked) == "Title & x One bold two three"
    assert pages.main_text(None) == "" and pages.main_text("a <b") == "a <b" and pages.main_text("<p>x<!-- y") == "x"
    plain = [(i, f"http://h/{i}", PAGE.replace("{}", f"<div class=top>Same line</div><div class=post><p>Body {i} " + f"word{i} " * 40
                                              + "</p></div>")) for i in range(6)]
    items = plain + [(10, None, marked), (11, "http://h/n", None), (12, "http://solo/", "<body>Only &eacute;\n text</body>")]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(items, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Body {i} " + " ".join([f"word{i}"] * 40)
    assert got[10].text == pages.main_text(marked) and got[11].text == "" and got[12].text == "Only é text"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert entities.unescape("&eacute;") == "é"


def texts_of(spark, items):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(items, "page_id long, url string, html string")).collect()}


def test_template_blocks_inside_articles(spark):
    page = ("<body><article><h1>Title {0}</h1><div class=box>Subscribe now</div><p>Text {0} of the page</p>"
            "<div class=share-prices>Prices {0}</div></article><div class=site-links>Link {0}</div><div>Lead {0}</div></body>")
    got = texts_of(spark, [(i, f"http://h/{i}", page.format(f"{i} " + "ab" * 20)) for i in range(5)])
    for i in range(5):
        x = f"{i} " + "ab" * 20
        assert got[i] == f"Title {x} Text {x} of the page Prices {x} Link {x} Lead {x}"
    part = page.replace("site-links", "site-sidebar").replace("Text {0}", "Text {0} " + "long {0} " * 30)
    got = texts_of(spark, [(i, f"http://h/{i}", part.format(f"{i} " + "ab" * 20)) for i in range(5)])
    assert all("Link" not in t and "Lead" in t and "Prices" in t and "Subscribe" not in t for t in got.values())


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article>{}</article></div>", "<div id=page class=no-sidebar><p>{}</p></div>",
    "<form action=/x><nav>a menu of many words that is long</nav><article>{}</article></form>", "<form><div>{}</div></form>",
    "<div class='post with-comments'><p>{}</p></div>", "<div class=widget><div>{}</div></div><nav>menu</nav>",
    "<article><div class=notice-of-award><p>{}</p></div></article>", "<head><title>t</title><body><p>{}</p></body>",
    "<div class=post>{}</div><div class=related><article>teaser</article></div>",
    "<article>{}</article><div class=comments><article>one comment that is longer than the text</article></div>"])
def test_names_do_not_bar_the_text(page):
    assert pages.main_text(f"<html><body>{page}<footer>foot</footer></body></html>".replace("{}", "The text itself.")) == "The text itself."


def test_copies_are_one_page(spark):
    def page(text, i):
        return f"<body><!-- {i} --><script>track({i})</script><div class=top>Head</div><div><p>{text}</p><p>More {text}</p></div></body>"

    items = [(i, "http://two/", page("Same article", i)) for i in (1, 2)] + [(3, "http://two/", page("Other", 3))]
    items += [(i, "http://many/", page("Same article" if i < 60 else f"Other {i}", i)) for i in range(10, 64)]
    got = texts_of(spark, items)
    assert got[1] == got[2] == "Head Same article More Same article" and got[3] == "Head Other More Other"
    for i in range(10, 64):
        text = "Same article" if i < 60 else f"Other {i}"
        assert got[i] == f"{text} More {text}"


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = [(d, t) for d, t, _ in items if not plain_rule(t)[-1]]
    heads = {d for d, _, c in plain_groups(kept) if d == c}
    got = corpus_pipeline.run(spark, folder)
    out = {r.doc_id for r in got.collect()}
    assert out <= heads and len(heads - out) <= len(heads) // 10
    stage = spark.createDataFrame([], docs.schema)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, stage, folder).write.parquet(f"{tmp_path}/{i}")
        stage = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{i}")
        assert stage.columns == docs.columns and stage.count() == 0


def plain_overlaps(texts, items, percent=80, least=13):
    """Best overlap of each document and item over all diagonals; of equal items the smallest id counts."""
    first = {}
    for i, t in sorted(items):
        first.setdefault(tuple(words_of(t, True)), i)
    places, out = {}, {}
    for item, i in first.items():
        for p, x in enumerate(item):
            places.setdefault(x, []).append((i, len(item), p))
    sizes = {i: item for item, i in first.items()}
    for d, t in texts:
        w, equal = words_of(t, True), {}
        for at, x in enumerate(w):
            for i, _, p in places.get(x, ()):
                equal[i, at - p] = equal.get((i, at - p), 0) + 1
        for (i, diagonal), n in sorted(equal.items()):
            item = sizes[i]
            need = min(least, -(-len(item) * percent // 100))
            if n < need:
                continue
            lo, hi = max(0, -diagonal), min(len(item), len(w) - diagonal)
            best = plain_stretch([item[k] == w[diagonal + k] for k in range(lo, hi)], need, percent)
            if best:
                start = diagonal + lo + best[0]
                row = (best[2], -start, len(item), start + best[1] - best[0] - 1)
                out[d, i] = max(out.get((d, i), row), row)
    return sorted((d, i, n, size, -start, last) for (d, i), (n, start, size, last) in out.items())


def table_rows(spark, folder, name, *columns):
    return list(map(tuple, spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()))


def test_overlaps_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_overlaps(table_rows(spark, folder, "documents", "doc_id", "text"),
                          table_rows(spark, folder, "benchmark", "item_id", "text"))
    assert want and rows(seeds.overlaps(docs, items)) == sorted(want, key=repr)


def test_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = table_rows(spark, folder, "documents", "doc_id", "text", "source")
    failed = {d: plain_rule(t)[-1] for d, t, _ in docs}
    hosts = {}
    for d, _, h in docs:
        hosts.setdefault(h, []).append(failed[d])
    hosts.pop(None, None)
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    spread = sum((sum(x) / len(x) - f / n) ** 2 * len(x) for x in hosts.values()) / n
    strength = min(max(f / n * (1 - f / n) / spread - 1, 1), 1e6) if spread else 1e6
    bad = {h for h, x in hosts.items() if (sum(x) + strength * f / n) / (len(x) + strength) > 0.9}
    kept = [(d, t) for d, t, h in docs if not failed[d] and h not in bad]
    heads = {d for d, _, c in plain_groups(kept) if d == c}
    seen, texts = set(), []
    for d, t in sorted((d, t) for d, t in kept if d in heads):
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            g = tuple(w[i:i + 20])
            if g in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(g)
        texts.append((d, " ".join(x for x, y in zip(w, gone) if not y) if any(gone) else t))
    hit = {r[0] for r in plain_overlaps(texts, table_rows(spark, folder, "benchmark", "item_id", "text"))}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in texts:
        if d not in hit:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert hit and rows(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens", "ids_sha256") == sorted(want, key=repr)


def test_equal_items_are_one_across_blocks(spark, monkeypatch):
    """Equal items count under their smallest id, however small the blocks of items are."""
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.select("item_id", "text")
    items = items.union(items.select(F.col("item_id") + 1000, F.upper("text"))).union(
        items.select(-F.col("item_id") - 1, F.regexp_replace("text", " ", "\t")).where("item_id % 3 = 0"))
    want = rows(seeds.overlaps(docs, items))
    monkeypatch.setattr(seeds, "BLOCK_WORDS", 50)
    assert want and rows(seeds.overlaps(docs, items)) == want
