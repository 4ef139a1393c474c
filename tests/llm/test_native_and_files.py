import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeline.llm import bpe, token_counts, token_files, url_filter, warc
from treeline.llm.batches import parts_of
from treeline.llm.fragments import ByteLevelEncoder, FragmentEncoder, byte_encoder, encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello, World! it's 1234", "  a  b\t\n c", "x \n \n\n  y\t \tz  ", "Straße ΑΣ ΑΣ. İ ǅ é ̈x", "<|endoftext|>foo<|startoftext|> <|ENDOFTEXT|>",
    "日本語テキスト😀😀 👩‍👩‍👧", "a" * 3000, "qzxjqzq9zq " * 30, "don't''re x're !!'s", "\xa0 \xa0b ª² µ½x x\x85y\x1cz", "b\r\nc\x0bd\x0ce",
]


def noise(rng, n):
    return ["".join(rng.choice("ab eét'0\n-Z😀İ ") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoders_equal_the_library():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    for text in TEXTS + noise(random.Random(2), 800):
        want = word.encode(text or "", add_special_tokens=False).ids
        got = encoder(WORD).ids(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert encoder(WORD).decode(got) == word.decode(want, skip_special_tokens=False)
        assert np.frombuffer(byte_encoder(BYTE).ids(text), "<u4").tolist() == byte.encode(text or "", add_special_tokens=False).ids


def test_tables_are_bounded():
    e, f, byte, word, rng = ByteLevelEncoder(BYTE), FragmentEncoder(WORD), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), random.Random(7)
    for table in (e.words, e.firsts, e.table, f.fragments, f.table):
        table.most = 2000
    for n in range(30):
        texts = TEXTS + noise(rng, 5) + [" ".join(f"w{rng.randrange(n + 1)}x{k},\nY" for k in range(10)), "x" * 5000 + f" {n}"]
        ids = e.batch(pa.array(texts).slice(n % 3))
        assert [i.tolist() for i in ids] == [byte.encode(t or "", add_special_tokens=False).ids for t in texts[n % 3 :]]
        ids, bounds = f.batch(pa.array(texts).slice(n % 3))
        want = [word.encode(t or "", add_special_tokens=False).ids for t in texts[n % 3 :]]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        assert [d.decode() for d in f.decoded(ids, bounds).to_pylist()] == [word.decode(w, skip_special_tokens=False) for w in want]
    assert len(e.words.keys) < 200 and len(f.fragments.keys) < 200


def test_parts_of_batches():
    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "text": ["abc", None, "", "é" * 10, "x" * 100, "a", "b"]})
    parts = list(parts_of(batch, 1, 10))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6]]


def test_prefix_counts_at_every_prefix():
    word = Tokenizer.from_file(WORD)
    for text in [t for t in TEXTS if len(t or "") < 500] + noise(random.Random(5), 150):
        counts = token_counts.counter(WORD).prefix_counts(text)
        want = [len(word.encode((text or "")[:n], add_special_tokens=False).ids) for n in range(len(text or "") + 1)]
        assert counts.tolist() == want, text
        for budget in (0, 1, 3):
            assert token_counts.PrefixCounter.longest_prefix(counts, budget) == max(n for n, c in enumerate(want) if c <= budget)


def test_prefix_counts_of_any_script():
    word, c, rng = Tokenizer.from_file(WORD), token_counts.counter(WORD), random.Random(4)
    parts = ["a", "É", "é", "x̣̂", "日本", "😀", "İ", "Σ", "'", "'s", "'re", "'LL", "́", "각", "ก้ำ", "ো", "1", "\x1c", "\x85", "　", "‍", "<|endoftext|>", "<|", "!!", "ﬁ", "Ω", " ", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(500)]
    texts += ["".join(rng.choices(rng.sample(parts[:-2], 3), k=60)) for _ in range(40)]
    for text in texts:
        want = [len(word.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert c.prefix_counts(text).tolist() == want, text


@pytest.mark.parametrize("text", ["日本語" * 30_000, "don't" * 20_000, "é" * 50_000, "ก้ำ" * 30_000, "'́" * 40_000, "ab<|endoftext|>" * 6_000, "a" * 100_000])
def test_prefix_counts_of_very_long_texts(text):
    began = time.process_time()
    counts = token_counts.counter(WORD).prefix_counts(text)
    assert time.process_time() - began < 20 and len(counts) == len(text) + 1
    assert counts[-1] == len(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)


def test_documents_through_the_operators(spark):
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "a", "x")], "doc_id long, text string, n_tokens string")
    word = Tokenizer.from_file(WORD)
    size = lambda t: len(word.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(r.doc_id), size(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.digest_documents(docs, WORD).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs, WORD).collect()) == want
    decoded = bpe.decode_documents(bpe.encode_documents(docs, WORD), WORD).collect()
    assert {r.doc_id: r.decoded for r in decoded}[4] == word.decode(word.encode(TEXTS[4], add_special_tokens=False).ids, skip_special_tokens=False)
    cut = {r.doc_id: r for r in token_counts.truncate(docs, WORD, 3).collect()}
    assert all(size(r.text) == r.n_tokens <= 3 for r in cut.values())
    empty = docs.limit(0)
    assert bpe.digest_documents(empty, WORD).count() == token_counts.count_tokens(empty, WORD).count() == 0


def test_token_files(spark, tmp_path):
    rows = [(n * 3, t) for n, t in enumerate(TEXTS + noise(random.Random(1), 60))] + [(9, "again"), (None, "no id")]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids long")
    path, byte = str(tmp_path / "t"), Tokenizer.from_file(BYTE)
    manifest = token_files.write_token_files(docs, path, token_files.encode_byte_level(BYTE), end_id=2, files=3, frame_bytes=64)
    found = sorted(token_files.read_token_files(manifest, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in found] == [i for i, _ in want]
    start = 0
    for row, (_, text) in zip(found, want):
        ids = byte.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, np.frombuffer(row.ids, "<u4").tolist()) == (start, ids)
        start += len(ids)
    some = token_files.read_token_files(manifest, path, [9, 30]).collect()
    assert sorted(r.doc_id for r in some) == [9, 9, 30]
    name = next(r.file for r in manifest.collect() if r.ids > 300)
    reader = token_files.TokenFileReader(f"{path}/{name}")
    read, frame = [], reader.frame
    reader.frame = lambda n: read.append(n) or frame(n)
    wanted = int(reader.doc_ids[-1])
    list(reader.documents([wanted]))
    assert len(reader.frames) > 3 and len(read) == 1
    raw = bytearray(open(f"{path}/{name}", "rb").read())
    raw[12] ^= 1
    open(f"{path}/{name}", "wb").write(raw)
    with pytest.raises(Exception):
        list(token_files.TokenFileReader(f"{path}/{name}").documents())
    none = token_files.write_token_files(docs.limit(0), str(tmp_path / "e"), token_files.encode_byte_level(BYTE))
    assert token_files.read_token_files(none, str(tmp_path / "e")).count() == 0


def test_warc(spark, tmp_path, monkeypatch):
    big = "é" * 600
    pages = [(1, "http://A.com/x?q#f", big), (2, "https://b.a.com/", big), (7, None, big), (3, "http://a.com/x", "small"), (4, "http://a.com/y", "small"), (5, "bad\r\nurl", None), (None, "http://n", big), (7, "http://seven", big), (8, "http://z.org", "z" * 1000)]
    df = spark.createDataFrame([(*p, "-") for p in pages], "page_id long, url string, html string, digest string")
    monkeypatch.setattr(warc, "FILE_BLOCKS", 2)
    path = str(tmp_path / "w")
    captures, files = warc.build(df, path, lines_of_block=2)
    found = warc.read_records(warc.look_up(df, files, path), path, 3).collect()
    got = sorted(((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in found), key=str)
    want = [("1", "revisit", 7, 1200), ("2", "revisit", 7, 1200), ("7", "response", None, 1200), ("7", "response", None, 1200), ("3", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0), ("None", "response", None, 1200), ("8", "response", None, 1000)]
    assert got == sorted(want, key=str)
    assert {r.payload.decode() for r in found if r.page_id == 7} == {big}
    index = warc.CaptureIndex(files, path)
    assert [r["X-Page-Id"] for r in index.records("http://a.com/y")] == ["4"]
    assert all([c[1] for c in index.captures(u or "")] == [i] for i, u, _ in pages if i not in (None, 7))
    assert index.records("http://a.com/x")[0]["payload"] == b"small" and index.records("http://nowhere/") == []
    assert warc.surt("http://Www.A.com/p?q") == "com,a,www)/p?q"
    some = spark.createDataFrame([("http://a.com/y",), ("http://nowhere/",), ("http://a.com/y",), (None,)], "url string")
    assert sorted(r.page_id for r in warc.look_up(some, files, path).collect()) == [4, 7]
    captures, files = warc.build(df.limit(0), str(tmp_path / "e"))
    assert captures.count() == files.count() == warc.look_up(df, files, str(tmp_path / "e")).count() == 0


def test_index_of_a_hot_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BLOCKS", 2)
    urls = ["http://hot.org/"] * 40 + [f"http://h{n % 9}.org/p{n}" for n in range(60)] + ["http://long.org/" + "x" * 5000, "http://É.org/", ""]
    df = spark.createDataFrame([(n, u, str(n)) for n, u in enumerate(urls)], "page_id long, url string, html string")
    captures, files = warc.build(df, str(tmp_path), lines_of_block=3)
    # the directory's keys are in order, and each look-up reads no more than its blocks
    index = warc.CaptureIndex(files, str(tmp_path))
    assert len(index.names) > 10 and sorted(index.keys) == index.keys and len(index.files_of(warc.surt(urls[0]))) > 4
    one = warc.IndexFile(f"{tmp_path}/{index.names[-1]}")
    read, inner = [], one.reader.read
    one.reader.read = lambda offset, length: read.append(offset) or inner(offset, length)
    assert one.captures(one.directory[-1][0]) and len(read) <= 2
    assert sorted(r.page_id for r in warc.look_up(df, files, str(tmp_path)).collect()) == list(range(len(urls)))
    for u in set(urls):
        assert sorted(c[1] for c in index.captures(u)) == [n for n, x in enumerate(urls) if x == u]


def judge(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match("[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match("[^?#]*", rest[len(host):])[0] if rest is not None else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in rules:
        rhost, _, rpath = rule.partition("/")
        rpath = "/" + rpath if "/" in rule else ""
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            best = max(best or (), (len(rhost + rpath), len(rhost), verdict == "block", rule, verdict))
    return (host, path, best[3] if best else None, best[4] if best else default)


@pytest.mark.parametrize("sweep_rows", [url_filter.SWEEP_ROWS, 3])
def test_urls_against_brute_force(spark, sweep_rows):
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "A.Com", "aa.com", "net", "x.net", ".com", "", "c.b.a.com"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x/y", "/es/", "?a=://", "#f", "/é/ÿ"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q/en', '#z'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://a.com/en/" ] * 3
    rules = [("allow", "com/"), ("block", "a.com/en/"), ("allow", "b.a.com/en/x"), ("block", "a.com/e"), ("allow", "net"), ("block", "net/es/"), ("block", "x.net/"), ("allow", "x.net/"), ("block", "com/é")]
    df = spark.createDataFrame([(n, u, "?") for n, u in enumerate(urls)], "page_id long, url string, host string")
    found = url_filter.filter_urls(df, url_filter.rules_frame(spark, rules), sweep_rows=sweep_rows).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {n: judge(u, rules, "allow") for n, u in enumerate(urls)}
    assert len(found) == len(urls)


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    none = url_filter.rules_frame(spark, url_filter.RULES).limit(0)
    assert url_filter.filter_urls(df, none, default="block").first().verdict == "block"
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0


def test_url_plan_is_native(spark):
    df = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com")], "page_id long, url string"), url_filter.rules_frame(spark, url_filter.RULES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Row)|Cartesian|NestedLoop", plan) and df.select(F.col("verdict")).count() == 1
