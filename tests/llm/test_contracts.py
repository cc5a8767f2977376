"""The queries against brute-force versions of their contracts, and the defined results of odd inputs."""

import hashlib
import re
from collections import Counter

import pytest

from loomline.llm import queries as q
from loomline.llm.bpe import decode, default_path, encode
from loomline.llm.decontaminate import decontaminate
from loomline.llm.html_extract import html_extract, main_text
from loomline.llm.near_dup import near_duplicates
from loomline.llm.quality_rules import quality_rules
from loomline.llm.url_filter import UrlRule, url_filter

AT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
TEXTS = [None, "", " \n\t", "one", "One two three four", LONG, "a b c d e f g\na b c d e f g", "a b c d e f g\na b c d e f g", "É É ß #x $ |<>", "<|endoftext|> it's  \u3000 日本語 12ⅷ\u0301 \U0001f600"]


def table(spark, name):
    return spark.read.parquet(f"{AT}/{name}.parquet")


def odd(spark):
    """Documents with nulls, empty, very long and repeated texts and clashing names."""
    rows = [(i, t, "w", 1, "q") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n_words int, quality string")


def by_id(df, key="doc_id"):
    return sorted(map(tuple, df.collect()), key=repr)


# op1


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    best = None
    for verdict, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_urls(spark):
    odd_urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/7", "a://x.example.com/en/77?q", "a://notexample.com/en/7", "b://com/en/", "c://xcom/en/1", "d://net/de/#", "e://example.net/de/8/x", "f://a.org/es/", "g://a.org/ES/", "h://a.com:80/en/", "i://b.com/en/\nz", "j://x://com/en/", "k://a.com/en/7", "l://a b.com/en/x", "m://free casino.com/en", "n://a\n.org/es/", LONG]
    rows = [(i, u, 5) for i, u in enumerate(odd_urls)] * 2
    mine = spark.createDataFrame(rows, "page_id long, url string, token int")
    for df in (mine, table(spark, "pages").select("page_id", "url")):
        got = url_filter(df).select("page_id", "url", "host", "path", "rule", "verdict").collect()
        assert len(got) == df.count()
        for r in got:
            host, path, best = judged(r.url)
            assert (r.host, r.path, r.rule) == (host, path, best and best[0]), r
            if best:
                assert r.verdict == best[1], r
            else:
                assert r.verdict in ("allow", "block")
    assert url_filter(mine.limit(0)).count() == 0
    assert "token" in url_filter(mine).columns
    # a rule without tokens is tried on every url
    got = url_filter(mine, (UrlRule("block", "^[^a]", ()), UrlRule("allow", "x", ("x",)))).select("host", "path", "verdict").collect()
    assert all(r.verdict == ("block" if (r.host + r.path)[:1] not in ("", "a") and "x" not in re.findall("[a-z0-9]+", (r.host + r.path).lower()) else r.verdict) for r in got)
    assert any(r.verdict == "block" for r in got)


# op2


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs, items):
    index = {}
    for item, text in items:
        w = doc_words(text)
        for i in range(max(0, len(w) - 13) + 1 if w else 0):
            index.setdefault(tuple(w[i : i + 13]), set()).add(item)
    widths, out = {len(x) for x in index}, []
    for doc_id, text in docs:
        w, hit, found = doc_words(text), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                at = index.get(tuple(w[i : i + n]))
                if at:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in at if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontaminate(spark):
    docs, items = (list(map(tuple, table(spark, t).select(k, "text").collect())) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert by_id(q.op2_decontaminate(spark, AT)) == contamination(docs, items)


def test_decontaminate_odd(spark):
    items = [(1, "w5 W6"), (2, " ".join(f"w{i}" for i in range(100, 130))), (3, None), (4, "..."), (5, "a b c d e f g"), (6, "b"), (6, "É É ß"), (7, " ".join(f"w{i}" for i in range(100, 130)))]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    df = odd(spark)
    out = decontaminate(df, table_)
    assert out.columns == [*df.columns, "contamination"]
    c = "contamination."
    got = out.selectExpr("doc_id", c + "n_words", c + "n_hit", f"cast(size({c}items) as long)", f"sha2(array_join({c}items, ','), 256)", c + "contaminated")
    assert by_id(got) == contamination([(r.doc_id, r.text) for r in df.collect()], items)
    assert decontaminate(df, table_.limit(0)).where("contamination.contaminated").count() == 0
    assert decontaminate(df.limit(0), table_).count() == 0


# op4


def test_html(spark):
    page = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><header><a href=#>Home</a></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies, and more cookies, on this site.</div><article><h1>Title &amp; more</h1><p>First  paragraph, with some&nbsp;text, and more of it to read.</p>
    <p>Second paragraph, also long enough, with <b>bold</b> words in it.<aside>Advert, buy this now, it is cheap.</aside></article><div id=comments><p>I disagree, said a reader, with all of this.</p></div><footer>Imprint</footer></body></html>"""
    assert main_text(page) == "Title & more\nFirst paragraph, with some text, and more of it to read.\nSecond paragraph, also long enough, with bold words in it."
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, None), (3, "", "", ""), (4, "v", "<p", ""), (5, "w", "<div><p>" + "word, " * 200_000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract(df).collect()
    assert sorted((r.page_id, len(r.text)) for r in got)[:5] == [(1, len(main_text(page)))] * 2 + [(2, 0), (3, 0), (4, 0)]
    assert max(len(r.text) for r in got) == 6 * 200_000 - 1
    assert html_extract(df.limit(0)).count() == 0
    assert q.op4_html_extract(spark, AT).count() == table(spark, "pages").count()


# op6


def counts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_rules(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in q.op6_quality_rules(spark, AT).collect():
        assert tuple(r)[1:7] == counts(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
    df = odd(spark)
    out = quality_rules(df).collect()
    assert len(out) == df.count()
    for r in out:
        assert tuple(r.quality[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts(r.text)
    assert quality_rules(df.limit(0)).count() == 0


# op9


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_truncation(), t.no_padding()
    df = odd(spark)
    for docs in (df, table(spark, "documents")):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = q.token_digests(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))), r.doc_id
            assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))
    assert decode(encode(df.limit(0))).count() == 0


@pytest.mark.parametrize("frequent, nearest", [(0, 0), (500, 100)])
def test_bpe_rare_words(spark, monkeypatch, frequent, nearest):
    from tokenizers import Tokenizer

    from loomline.llm import bpe

    t = Tokenizer.from_file(default_path())
    t.no_truncation(), t.no_padding()
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    monkeypatch.setattr(bpe, "NEAREST", nearest)
    docs = table(spark, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = encode(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids, r.doc_id


def test_bpe_small_batches(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from loomline.llm import bpe

    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 5)
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 7)
    assert list(bpe._cuts(np.array([3, 3, 9, 0, 1]), 5)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    with open(default_path(), encoding="utf-8") as f:
        spec = SimpleNamespace(value=f.read())
    texts = ["a b", None, "", "größer als 7 bytes", "a b a b", "x"]
    vocabulary = {w: i for i, w in enumerate(["a", " b", "x"])}
    own = [np.array(bpe._library(spec.value).encode(w, add_special_tokens=False).ids, np.uint16).tobytes() for w in vocabulary]
    hashes = np.array([bpe_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)
    shared = [SimpleNamespace(value=bpe._as_bytes(**c)) for c in ({"word": ["a"]}, {"h": hashes[order], "rank": order.astype(np.int32)}, {"ids": pa.array(own, pa.binary())})]
    n = len(texts)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(range(n)), pa.array(texts, pa.string())], ["k1", "k2", "doc_id", "text"])
    packed = list(bpe._packed(spec, *shared[:2])(iter([rows.slice(0, 2), rows.slice(2)])))
    assert sum(b.num_rows for b in packed) == n and len(packed) > 2
    whole = pa.Table.from_batches(packed).combine_chunks().to_batches()[0]
    listed = pa.Table.from_batches(bpe._listed(iter([whole.slice(0, 1), whole.slice(1)]))).to_pylist()
    found = [[{"k": r["k"], "ids": np.array(bpe._library(spec.value).encode(r["word"], add_special_tokens=False).ids, np.uint16).tobytes()} for r in reversed(listed) if r["k1"] == i] or None for i in range(n)]
    kind = pa.list_(pa.struct([("k", pa.int32()), ("ids", pa.binary())]))
    filled = list(bpe._filled(shared[2], np.uint16)(iter([whole.append_column("found", pa.array(found, kind))])))
    want = [bpe._library(spec.value).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x for b in filled for x in b.column("ids").to_pylist()] == want and len(filled) == 2
    decoded = list(bpe._decoded(spec)(iter(filled[:1] + [pa.Table.from_batches(filled[1:]).combine_chunks().to_batches()[0]])))
    assert [x for b in decoded for x in b.column("decoded").to_pylist()] == [t or "" for t in texts]


def bpe_hash(word):
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode(), 42)


# op10


def linked(rows, percent):
    """[(doc_id, n_shingles, component_id, kept)] by comparing every two documents; doc_ids are distinct."""
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def chains():
    """Chains and groups of near copies whose links cross."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60 + g)]
        for k in range(12):
            rows.append((1000 * (12 - k) + g, " ".join(base[k * (1 + g % 3) :] + [f"t{g}" for _ in range(k % 2)])))
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    docs = table(spark, "documents").select("doc_id", "text")
    rows = list(map(tuple, docs.collect()))
    assert sorted(map(tuple, near_duplicates(docs, percent).collect())) == linked(rows, percent)
    mine = chains()
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(mine, "doc_id long, text string"), percent).collect())) == linked(mine, percent)


def test_near_duplicates_odd(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, digest int, rep string")
    assert sorted(map(tuple, near_duplicates(df, 85).collect())) == linked(rows, 85)
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.component_id, r.kept) for r in near_duplicates(twice).collect()) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0), 85).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share a doc_id are judged each by its own text."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "quite another text of its own words"), (1, long), (2, long + " more"), (3, "quite another text of its own words")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 3, 1, False)]


def test_near_duplicates_of_text_ids_and_large_numbers(spark):
    mine = [(f"d{i:05d}", t) for i, t in chains()]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(mine, "doc_id string, text string"), 85).collect())) == linked(mine, 85)
    rows = [(2**62 + 1, "a b c d e f"), (None, "a b c d e f"), (None, "g h i"), (None, "g h i"), (2**62 + 3, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(2**62 + 1, 2, 2**62 + 1, True), (None, 2, 2**62 + 1, False), (None, 1, None, False), (None, 1, None, False), (2**62 + 3, 0, 2**62 + 3, True)], key=repr)


def test_near_duplicates_meet_in_shares(spark, monkeypatch):
    """A shingle that all documents have is met in shares, and no link is lost."""
    monkeypatch.setattr("loomline.llm.near_dup.SHARE_ROWS", 3)
    mine = [(i, "x y z u v " + t) for i, t in chains()]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(mine, "doc_id long, text string"), 80).collect())) == linked(mine, 80)
