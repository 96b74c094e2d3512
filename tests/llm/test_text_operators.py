"""PII, decontamination, quality bands and tokens against brute force."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import plan_of
from pyspark.sql import functions as F

import plain
from rows import SF, none, odd  # noqa: F401
from tidewatch.llm import bpe, decontam, pii, quality_bands, queries
from tidewatch.llm.common import table

PATH, PATTERN = queries.tokenizer()


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_base_spans(spark, odd, none, which):
    docs = {"odd": odd, "none": none, "sf": table(spark, SF, "documents")}[which]
    got = sorted(((r.doc_id, *r[1:5], r.base_sha256) for r in pii.report(docs).collect()), key=key)
    want = []
    for d, t in texts_of(docs):
        spans = plain.base_pii(t)
        want.append((d, *(sum(s[0] == k for s in spans) for k in range(4)), plain.sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans))))
    assert got == sorted(want, key=key)


def test_base_spans_random(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        rows.append((i, "".join(rng.choice(["a", "b.", "@", "@x.y", "1", "22", ".", "-", " ", "+1 ", "(", ")", "\n", "é😀", "_", "255", "4111111111111111", "%"]) for _ in range(rng.randint(0, 60)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.base_spans(docs).collect()}
    assert got == {d: plain.base_pii(t) for d, t in rows}


def test_many_matches_in_one_text(spark):
    text = "a@b.cd " * 5000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(s.kind, s.start, s.end) for s in pii.base_spans(docs).first().base] == plain.base_pii(text)


def test_contexts_reveal_what_the_patterns_miss(spark):
    rows = [(i, f"Some words here. Please mail user{i}@mail.example.com for more on it.") for i in range(12)]
    rows += [(20, "Some words here. Please mail hidden@intranet for more on it."), (21, "In 1999 the price was 300 and room 12 was free."), (22, "He saw nobody@all there.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    at = rows[12][1].index("hidden")
    assert got[20].spans == f"email:{at}:{at + len('hidden@intranet')}" and got[20].n_email == 0
    assert got[21].spans == "" and got[22].spans == ""
    assert all(got[i].spans == "email:29:%d" % (29 + len(f"user{i}@mail.example.com")) for i in range(12))


@pytest.mark.parametrize("block_words", [50_000, 40])
def test_contamination(spark, odd, block_words):
    rng = random.Random(2)
    vocab = ["aa", "bb", "Cc", "dé", "e1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30, 90])))) for i in range(25)]
    items += [(30, None), (None, "wait for it"), (3, items[3][1]), (31, "9.9.9.9.9")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    rows += [(100 + i, f"Start {items[i][1]}, aa zz {items[-i][1]} end") for i in range(20)] + texts_of(odd)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r.items)) for r in decontam.contamination(docs, bench, block_words=block_words).collect()), key=key)
    assert got == sorted(((d, *plain.contamination(t, items)) for d, t in rows), key=key)
    assert len(decontam.item_blocks(bench, block_words)) == (1 if block_words > 1000 else got and -(-sum(len(plain.bench_words(t)) for _, t in items) // 40) or 0) or block_words == 40


def test_contamination_report_on_the_tables(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = []
    for d, t in texts_of(docs):
        n, hit, names = plain.contamination(t, items)
        want.append((d, n, hit, len(names), plain.sha(",".join(names)), hit > 0))
    assert sorted(map(tuple, decontam.report(docs, bench).collect())) == sorted(want)


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")], "item_id long, text string")
    passage = "One, two three. Four five six seven eight nine ten eleven"
    filler = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{filler} {passage}! end", 1), (2, passage, 2), (3, f"{filler} short item", 3), (4, None, 4)], "doc_id long, text string, spans int")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: f"{filler} ! end", 3: f"{filler} short item", 4: None}
    out = decontam.decontaminate(odd, bench)
    assert out.columns == odd.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd.collect()))
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_document_of_a_short_item_goes(spark):
    bench = spark.createDataFrame([(1, "what is the capital of chad")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "What is the capital of Chad?"), (2, "Ask: what is the capital of Chad? I do not know it, and neither do you.")], "doc_id long, text string")
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).collect()] == [(2, docs.collect()[1].text)]


def test_one_block_is_scanned_and_cut_in_one_worker(spark):
    """Each further Python function of a stage is a further worker per core; more blocks give the same texts."""
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate([3, 10, 14, 30])]
    parts = [t for _, t in items] + ["i2w0 i2w1 i2w2 i2w3", "i3w5 " * 2, *(f"x{i} y{i}" for i in range(9))]
    docs = spark.createDataFrame([(i, " . ".join(rng.choices(parts, k=rng.randint(1, 6))), str(i)) for i in range(80)] + [(80, None, "n"), (81, "", None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, more = decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, block_words=15)
    assert plan_of(one.select("doc_id")).split("== Physical")[-1].count("MapInArrow") == 1
    got = sorted(map(tuple, one.collect()), key=key)
    assert got == sorted(map(tuple, more.collect()), key=key) and 2 < len(got) < 80


def test_rest_of_a_cut_item_is_no_item(spark):
    items = [(1, " ".join(f"w{i}" for i in range(43)))]
    rows = [(1, "x w40 w41 w42 y"), (2, " ".join(f"w{i}" for i in range(33, 43))), (3, " ".join(f"w{i}" for i in range(35, 43)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r.items)) for r in decontam.contamination(docs, bench, block_words=40).collect())
    assert got == [(d, *plain.contamination(t, items)) for d, t in rows]


def test_empty_benchmark(odd, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.report(odd, bench).collect()), key=key)
    assert got == sorted(((d, len(plain.bench_words(t)), 0, 0) for d, t in texts_of(odd)), key=key)


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_quality_counts(spark, odd, none, which):
    docs = {"odd": odd, "none": none, "sf": table(spark, SF, "documents")}[which]
    got = sorted((tuple(r[:7]) for r in quality_bands.compression_bands(docs).collect()), key=key)
    assert got == sorted(((d, *plain.quality(t)) for d, t in texts_of(docs)), key=key)


def test_quality_counts_random():
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        assert quality_bands.repeated_words([w.encode() for w in words]) == plain.quality(" ".join(words))[4]


def test_bands(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(100))
    prose = " ".join("".join(rng.choice(["an", "ti", "on", "er", "th", "e"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    slow = " ".join(f"{'ab' * 30}{i % 7}" for i in range(400))
    docs = spark.createDataFrame([(1, noise), (2, prose), (3, slow), (4, noise * 2 + prose)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_bands.compression_bands(docs).collect()}
    assert got[2].kept and not got[3].kept
    assert quality_bands.measure(" ".join(f"{'ab' * 30}{i:03d}" for i in range(400)), __import__("zstandard").ZstdCompressor(level=3))[-1] == "repetitive"


def test_noise_is_out_of_band(spark):
    rng = random.Random(1)
    base64_letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(base64_letters) for _ in range(60)) for _ in range(100))
    prose = " ".join("".join(rng.choice(["an", "ti", "on", "er", "th", "e"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    docs = spark.createDataFrame([(1, noise), (2, prose), (4, noise * 2 + prose)], "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.verdict) for r in quality_bands.compression_bands(docs).collect()} == {1: (False, "incompressible"), 2: (True, "kept"), 4: (False, "chunks")}
    packer = __import__("zstandard").ZstdCompressor(level=3)
    words = lambda letters, n: "".join(" " if i % 8 == 7 else rng.choice(letters) for i in range(n))
    for n in (320, 384, 512, 700, 1024, 2000, 4096, 20_000, 200_000):
        for letters in ("".join(map(chr, range(33, 127))), base64_letters, *(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"] if n >= 4096 else [])):
            assert quality_bands.measure(words(letters, n), packer)[-1] == "incompressible"


def test_chunks_cover_the_tail():
    rng, packer = random.Random(6), __import__("zstandard").ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice(["an", "ti", "on", "er", "th", "e"]) for _ in range(rng.randint(1, 4))) for _ in range(1200))
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(2000))
    assert quality_bands.measure(prose[:4096] + noise, packer)[-2:] == (2000 / 6096, "chunks")
    assert quality_bands.measure(prose[:4096] + "a" * 2000, packer)[-2:] == (2000 / 6096, "chunks")
    assert quality_bands.measure(prose[:6096], packer)[-2:] == (0.0, "kept") and quality_bands.measure(prose[:4096] + noise[:900], packer)[-1] == "kept"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_odd_strings(reference):
    enc, rng = bpe.encoder(PATH, PATTERN), random.Random(3)
    letters = "ab 'stlvred\n\t\x0b\x0c\r\x1c\x1f\x85\xa0 ​　Éß漢½Ⅷ٣_1 0😀é\x00\x7f-.,!?  "
    for i in range(4000):
        text = "".join(rng.choice(letters if i % 2 else "abcdehlorstin t") for _ in range(rng.randint(0, 40)))
        ids = enc.encode(text)
        assert ids == reference.encode_ordinary(text) and enc.decode(ids) == text.encode()


def test_the_passed_pattern_counts(reference):
    other = r"\p{L}+|\s|[^\p{L}\s]"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    want, enc = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={}), bpe.encoder(PATH, other)
    for text in ("it's 1234 plain words,  two blanks", "ünï 42x\n\n\tend"):
        assert enc.encode(text) == want.encode_ordinary(text) != reference.encode_ordinary(text)


def test_caches_forget_the_oldest():
    made = []
    cache = bpe.Recent(lambda k: made.append(k) or k + 1, 3)
    for k in (1, 2, 3, 1, 4, 1, 5, 6, 1, 2):
        assert cache[k] == k + 1 and len(cache) <= 3 and len(cache.old) <= 3
    assert made.count(1) == 1 and made.count(2) == 2


def test_prefix_table_appends_and_edits(reference):
    enc, rng = bpe.encoder(PATH, PATTERN), random.Random(5)
    whole = lambda b: list(enc.vocab.bytes[i] for i in bpe.PrefixTable(enc.vocab, b).ids())
    for _ in range(200):
        t = bpe.PrefixTable(enc.vocab)
        for _ in range(4):
            t.append(rng.choice([b"the", b"ing", b"xx", b"an", b"qu\xc3\xa9", b"e"]))
        at = rng.randint(0, len(t.data))
        t.edit(at, rng.randint(0, len(t.data) - at), b"ter")
        assert [enc.vocab.bytes[i] for i in t.ids()] == whole(t.data)
        if t.data.isascii():
            assert t.ids() == reference.encode_ordinary(t.data.decode())


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_token_digests(spark, odd, none, which, reference):
    docs = {"odd": odd, "none": none, "sf": table(spark, SF, "documents")}[which]
    want = []
    for d, t in texts_of(docs):
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(t or "")))
    assert sorted(map(tuple, bpe.digests(docs, PATH, PATTERN).collect()), key=key) == sorted(want, key=key)
    out = bpe.verified(docs, PATH, PATTERN)
    assert out.filter("not intact").count() == 0 and out.count() == len(want)
    assert set(odd.columns) - {"ids"} <= set(bpe.encode(odd, PATH, PATTERN).columns)
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
