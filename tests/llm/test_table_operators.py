"""WARC, ring, classifiers, line templates, near-duplicates and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
import plain
from rows import SF, TEXTS, none, odd  # noqa: F401
from tidewatch.llm import langid, line_templates, neardup, quality_model, ring, warc
from tidewatch.llm.common import table, written
from tidewatch.session import shared_dir


def key(row):
    return tuple((x is None, str(x)) for x in row)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# WARC

def want_pages(rows):
    first = {}
    for i, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        again = i is not None and html in first and first[html] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=key)


def test_warc_round_trip(spark):
    big = "<p>éß" * 400_000
    rows = [(1, "x" * 100), (2, "x" * 100), (3, "x" * 99), (4, "x" * 99), (5, None), (6, ""), (7, "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, big), (9, big), (None, "x" * 100), (2, "x" * 100), (1, "x" * 100), (10, "é" * 50)]
    pages = spark.createDataFrame([(i, f"http://h/{i}?q=1 2\r\nX: y" if i != 3 else None, h, 1) for i, h in rows], "page_id long, url string, html string, digest int").repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=key) == want_pages(rows)
    full = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, shared_dir(spark, "w"), roll_bytes=500)).collect()}
    assert bytes(full[8].payload).decode() == big and full[9].payload is None and full[3].url is None and "\n" not in full[7].url
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_the_pages(spark):
    pages = table(spark, SF, "pages")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=key) == want_pages([(r.page_id, r.html) for r in pages.collect()])


class Stream:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        out, self.data = self.data[:n], self.data[n:]
        return out


def test_one_member_per_record_and_damage():
    recs = [warc.record(i, "http://h", b"payload %d" % i * 50, hashlib.sha256(b"payload %d" % i * 50).hexdigest(), None, False) for i in range(5)]
    data = b"".join(map(warc.member, recs))
    for size in (1, 7, 1 << 20):
        assert [f["warc-record-id"] for f, _ in warc.records(Stream(data), size)] == [f"<urn:x-page:{i}>" for i in range(5)]
    assert zlib.decompressobj(31).decompress(data) == recs[0]
    for broken in (data[:-5], data[:40] + bytes([data[40] ^ 1]) + data[41:], warc.member(recs[0].replace(b"payload 0payload", b"payload 1payload")), warc.member(recs[0][:-1]), warc.member(b"nothing")):
        with pytest.raises(warc.WarcError):
            for f, b in warc.records(Stream(broken)):
                warc.page(f, b)


# Ring

def check_shards(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=key)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    return Counter({s: len(by.get(s, [])) for s in range(shards)})


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_ring_rows_law(spark, odd, none, which):
    docs = {"odd": odd, "none": none, "sf": table(spark, SF, "documents")}[which]
    counts = check_shards(texts_of(docs), ring.shard_rows(docs).collect(), 16)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_ring_hot_key(spark):
    docs = spark.range(3000).selectExpr("if(id < 2000, 7, id) doc_id", "'same' text").repartition(8)
    counts = check_shards(texts_of(docs), ring.shard_rows(docs, 5).collect(), 5)
    assert set(counts.values()) == {600}


def test_ring_bounds_and_movement(spark):
    docs = table(spark, SF, "documents")
    n = docs.count()
    a = {r.doc_id: r.shard for r in ring.shard_rows(docs, 10, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in ring.shard_rows(docs, 11, slack=0.25).collect()}
    assert max(Counter(a.values()).values()) <= -(-n * 5 // 40)
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)  # modulo hashing moves nine tenths


def test_ring_arc_is_the_next_point(spark):
    pts = ring.points(3, 5)
    rows = [(x,) for x in [0, 2**31 - 1, *[a for a, _ in pts], *[a + 1 for a, _ in pts]]]
    from pyspark.sql import functions as F
    got = spark.createDataFrame(rows, "p int").select("p", ring.arc_of(F.col("p"), pts).alias("arc")).collect()
    for r in got:
        assert r.arc == next((i for i, (a, _) in enumerate(pts) if a >= r.p), 0)


# Classifiers

def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs, langid.fit(langid.sample(docs)))
    held = found.filter(~langid.in_training(found.doc_id)).select("lang", "lang_pred", "score", "ambiguous").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(spark, odd, none):
    model = langid.fit(langid.sample(table(spark, SF, "documents")))
    got = langid.identify(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score", "ambiguous"]
    for r in got.select("text", "lang_pred", "score").collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert langid.identify(none, model).count() == 0
    assert langid.fit(langid.sample(none)).predict("some text")[0] == "und"
    one = langid.fit([r for r in langid.sample(table(spark, SF, "documents")) if r.lang == "en"])
    assert one.predict("some text") == ("en", 1.0, False)


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_differ(k):
    code = langid.codewords(k)
    gap = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
    assert gap >= (1 if k == 2 else code.shape[1] // 4)


def test_flipped_bits_are_corrected():
    import numpy as np
    code = langid.codewords(12)
    m = langid.CodeModel([str(i) for i in range(12)], code, None, None, np.ones(code.shape[1]))
    for i in range(12):
        margins = code[i] * 3.0
        margins[[1, 5]] *= -1
        assert m.decode(margins)[0] == str(i)
    assert m.decode(np.zeros(code.shape[1]))[2]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.fit(quality_model.sample(docs, labels), quality_model.class_balance(labels))
    held = quality_model.score(docs, model).join(labels, "doc_id").filter(~langid.in_training(labels.doc_id)).collect()
    assert sum((r.score >= 0.5) == r.quality for r in held) > 0.93 * len(held) > 50


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_model.fit(quality_model.sample(odd, labels), quality_model.class_balance(labels))
    got = quality_model.score(odd, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(none, model).count() == 0


# Line templates

def test_templates(spark, odd, none):
    long = "this is a rather long line of words that says the very same thing over again in each of the documents ok"
    rows = [(i, f"own line {'abcdefgh'[i]} {'xyzuvwst'[i]} here\nPosted by user{i} on day {i}\n\nCopyright notice: all rights reserved\n{long}") for i in range(6)]
    rows += [(20, long.replace("very", "quite")), (21, "Copyright notice: all rights reserved\nCopyright notice: all rights reserved"), (None, "Copyright notice: all rights reserved"), (23, None), (24, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row_key int, at int")
    out = line_templates.drop_recurring(docs)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got[0] == (rows[0][1], 5, 0)
    for i in range(1, 6):
        assert got[i] == (f"own line {'abcdefgh'[i]} {'xyzuvwst'[i]} here\n", 5, 3)
    assert got[20] == ("", 1, 1) and got[21] == ("", 2, 2) and got[None] == ("", 1, 1) and got[23] == (None, 0, 0) and got[24] == ("", 1, 0)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and all(r.row_key == 1 and r["at"] == 2 for r in out.collect())
    same = line_templates.drop_recurring(odd)
    assert sorted(map(repr, same.select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert line_templates.drop_recurring(none).count() == 0


def test_many_templates_in_one_leaf(spark):
    start, rng = "Click here to read more about", random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklmnp") for _ in range(9))
    ends = [[word() for _ in range(6)] for _ in range(40)]
    rows = []
    for i in range(6):
        for e in ends:  # each variant is in one document
            rows.append((len(rows), f"{start} {' '.join(e[:5])} {word()}"))
    rows += [(1000 + i, f"{start} {' '.join(word() for _ in range(6))}") for i in range(3)]
    rows += [(2000 + i, f"{start} an unrelated line that repeats itself") for i in range(4)]  # of more copies than any variant, too few to go
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(docs).collect()}
    assert got == {i: int(40 <= i < 1000) for i, _ in rows}


def test_lines_of_one_document_count_once(spark):
    lines = [f"Always the same words and one {x} here" for x in ("apple", "grape", "lemon", "melon", "peach")]
    rows = [(1, "\n".join(lines[:4])), (2, lines[4]), *[(i, f"Other words that all {x} share") for i, x in enumerate("abcde", 3)], (9, "One more line that comes\nOne more line that goes"), *[(10, "One more line that repeats")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_dropped) for r in line_templates.drop_recurring(docs).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 1), (9, 0), (10, 0), (10, 0), (10, 0)]


@pytest.mark.parametrize("seed,patterns", [(1, 1), (2, 3), (3, 64)])
def test_templates_as_line_by_line(spark, seed, patterns):
    rng = random.Random(seed)
    lines = {"".join(rng.choice("ab") if i < 3 else rng.choice("abc") for i in range(rng.choice([3, 7, 10]))): rng.randint(1, 4) for _ in range(150)}
    rows = [(s.encode(), s, n, 1) for s, n in lines.items()]
    want, leaves = {}, {}
    for n, s in sorted(((n, s) for s, n in lines.items()), reverse=True):
        known = leaves.setdefault((len(s), s[:3]), [])
        fit = next((p for p in known if sum(a == b for a, b in zip(p, s)) >= 0.7 * len(s)), None)
        if fit is None:
            known.append(fit := s)
        want[s] = fit
    from pyspark.sql import functions as F
    found = line_templates.templates(spark.createDataFrame(rows, "name binary, sketch string, n long, first long"), F.lit(1), patterns=patterns)
    assert {bytes(r.name).decode(): bytes(r.template).decode() for r in found.collect()} == want and found.count() == len(want)


def test_line_counts_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    masks = lambda t: {tuple("<*>" if any(c in "0123456789" for c in w) else w for w in x.split()) for x in (t or "").split("\n")} - {()}
    n, first = Counter(), {}
    for d, t in texts_of(docs):
        for m in masks(t):
            n[m] += 1
            first[m] = min(d, first.get(m, d))
    found = line_templates.line_counts(docs).collect()
    assert sorted((len(r.sketch), r.n, r["first"]) for r in found) == sorted((len(m), c, first[m]) for m, c in n.items())
    assert len({bytes(r.name) for r in found}) == len(n)


# Near-duplicates

def copies(seed, n=120):
    rng, rows = random.Random(seed), []
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = (rng.choice(rows)[1] or "a b").split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((1000 - i, " ".join(words)))
        else:
            rows.append((1000 - i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 8, 40, 120])))))
    return rows


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5), (3, 2)])
def test_classes_against_all_pairs(spark, seed, width):
    rows = copies(seed) + [(-1, None), (-2, ""), (None, None), (None, "only words no id"), (5, "only words no id"), (5, "other text"), (6, "x"), (7, "X ")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = sorted((tuple(r)[0:1] + tuple(r)[2:] for r in neardup.classes(docs, width).collect()), key=key)
    assert got == sorted(plain.classes(rows, width, 80), key=key)


def test_classes_of_the_documents(spark):
    rows = texts_of(table(spark, SF, "documents"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classes(table(spark, SF, "documents"), 2).collect())
    assert got == sorted(plain.classes(rows, 2, 80))


def test_deduplicate(spark, odd, none):
    rows = copies(5, 60) + [(3000, None), (3001, "")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, _id int, _key int")
    kept = {d for d, _, _, k in plain.classes(rows, 5, 80) if k}
    out = neardup.deduplicate(docs)
    assert {r.doc_id for r in out.collect()} == kept and out.columns == docs.columns
    assert sorted(map(repr, neardup.deduplicate(odd).collect())) == sorted(map(repr, odd.collect())) and neardup.deduplicate(none).count() == 0


@pytest.mark.parametrize("n", [12, 60, 600, 6000])
def test_odd_sketch_estimates(spark, n):
    """Pairs of similarity 0.8 pass, clearly lower ones don't (where sets are not tiny)."""
    import numpy as np
    rng, rows = np.random.default_rng(n), []
    for j in [0.8] * 300 + [0.5] * 50:
        common = int(-(-2 * n * j // (1 + j)))
        pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
        (ka, a), (kb, b) = (neardup.odd_sketch(np.unique(s)) for s in (pool[:n], np.concatenate((pool[:common], pool[n:]))))
        rows.append((j, {"n": n, "samples": ka, "sketch": a.tolist()}, {"n": n, "samples": kb, "sketch": b.tolist()}))
    side = "struct<n:int,samples:int,sketch:array<bigint>>"
    got = spark.createDataFrame(rows, f"j double, x {side}, y {side}").select("j", neardup.alike("x", "y", 80).alias("ok")).collect()
    assert all(r.ok for r in got if r.j == 0.8)
    assert n < 100 or sum(r.ok for r in got if r.j == 0.5) <= 2


# Pipeline

def test_pipeline_stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert seen == sorted(seen, reverse=True) and docs.filter("not intact").count() == 0
    rows = texts_of(docs)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sum(plain.contamination(t, items)[1] for _, t in rows) == 0


def test_shortened_texts_are_counted_anew(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line dedup", "benchmark decontamination"):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            assert out.filter("n_chars IS DISTINCT FROM length(text)").count() == 0
            assert out.join(docs.withColumnRenamed("text", "old"), "doc_id").filter("text <> old").count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (base, base.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_pipeline_has_its_own_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
