"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import chat, compaction, decontam, line_dedup, packing, pii, quality, queries, records, simhash, url_filter

DATA = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over " * 3000
SCHEMA = "doc_id long, text string, fp string, key string, kept boolean"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", True) for i, t in rows], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    base = [words(r, 80) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)] + [(10, base[0]), (11, base[0]), (12, None), (13, ""), (14, " \t\n"), (15, LONG), (16, "ÀÉ one"), (16, "ÀÉ one"), (None, base[1]), (17, base[2] + " end")]
    return rows


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    rows = lambda data, names: sorted(tuple(str(x[names.index(c)]) for c in cols) for x in data)
    assert cols == sorted(want.columns) and rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.B.Org/x?y", "https://example.org/es/1", "https://m.example.org/en/12#t", "http://x.com/fr/1", "x://de.com/de/", "http://com", "http://notexample.org/es/", "ftp://a://b/c"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    model = url_filter.fit(url_filter.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge(pages, model, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for _, r in queries.URL_RULES if (host + "/").endswith("/" + r) or ((h := r.split("/", 1))[0] == host or host.endswith("." + h[0])) and path.startswith("/" + h[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (dict((r, v) for v, r in queries.URL_RULES)[rule] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), model, ()).count() == 0


def test_url_model_on_held_out_urls(spark):
    rows = url_filter.labelled_urls(spark).withColumn("page_id", F.pmod(F.xxhash64("url"), F.lit(5)))
    model = url_filter.fit(rows.where("page_id <> 0"))
    held = rows.where("page_id = 0")
    right = url_filter.judge(held.select("page_id", "url"), model, ()).groupBy("verdict").count()
    assert sum(r["count"] for r in right.collect()) == held.count()
    judged = url_filter.judge(held.withColumn("page_id", F.col("label").cast("long")), model, ()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id) for r in judged]) > 0.95


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, least_ids):
    nodes, root = sorted(fps), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    out = collections.defaultdict(list)
    for f in nodes:
        out[find(f)] += least_ids[f]
    return {f: min(out[find(f)], default=None) for f in nodes}


@pytest.mark.parametrize("group_rows", [1, 256])
def test_simhash(spark, odd, group_rows):
    ids = collections.defaultdict(list)
    for i, t in odd:
        ids[brute_fingerprint(t)] += [] if i is None else [i]
    want = components(set(ids), ids)
    got = simhash.near_duplicates(docs_of(spark, odd), group_rows=group_rows).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == sorted((str(i), f := brute_fingerprint(t), str(want[f])) for i, t in odd)
    assert simhash.near_duplicates(docs_of(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [2, 256])
def test_links_of_a_crowd(spark, group_rows):
    """Fingerprints around a few centres: chains of small steps, many in one segment."""
    r = random.Random(7)
    fps = {0}
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                x ^= 1 << r.randrange(64)
            if r.random() < 0.2:
                x ^= 1 << r.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from attestra.llm.components import connected_components

    got = {x.node: x.root for x in connected_components(simhash.links(df, group_rows=group_rows)).collect()}
    want = components(fps, {f: [f] for f in fps})
    groups = lambda m: {frozenset(v) for v in m.values() if len(v) > 1}
    by = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        by[0][want[f]].add(signed(f))
        by[1][got.get(signed(f), signed(f))].add(signed(f))
    assert groups(by[0]) == groups(by[1])


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.deduplicated(docs_of(spark, odd))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and not {10, 11, 13, 14, None} & set(ids)


def test_compaction(spark, tmp_path):
    data = compaction.ShardedDataset(spark, f"file://{tmp_path}/d", shard_rows=50, fanout=3, least_bytes=1 << 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(1).alias("_run"))
    for k in range(7):
        data.append(docs.where(F.col("doc_id") % 7 == k))
    data.append(docs.limit(0))
    before, (version, runs) = data.read().count(), data.manifest()
    assert before == 1000 and version == 7 and len(runs) == 7
    assert data.compact() and len(data.manifest()[1]) < 7 and data.manifest(7)[1] == runs
    assert not data.commit(data.manifest()[0] - 1, [])  # another writer has made that version
    assert sorted(map(tuple, data.read().collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert data.vacuum() >= 3 and data.read().count() == 1000 and len(data.versions()) == 1


def test_packing(spark, odd):
    path = queries.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = odd + [(100 + i, words(random.Random(i), 30 + 40 * i)) for i in range(40)] + [(900, "don't İx <|endoftext|> é 1½ a_b  ''s")]
    got = packing.pack(docs_of(spark, rows).repartition(2), path, batch_tokens=3000).collect()
    texts = collections.Counter((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in rows)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_seq[p.sequence_id].append(p)
    for (i, n), ps in by_doc.items():
        copies = sum(c for (j, _), c in texts.items() if j == i and len(tok.encode(next(t or "" for k, t in rows if k == j), add_special_tokens=False).ids) + 1 == n)
        assert sum(p.length for p in ps) == n * copies
        if copies == 1:
            assert (i, zlib.crc32(b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)))) in texts
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1])
        total, window = sum(p.length for p in ps), ps[0].window
        assert total <= window <= 2048 and (total == window or window == 2048)
        padding += window - total
    assert padding <= 2 * 2048
    assert packing.pack(docs_of(spark, rows).limit(0), path).count() == 0


def test_step_groups_are_balanced():
    sizes = [2048] * 40 + [256] * 64 + [512] * 9
    load = collections.Counter()
    for s, g in zip(sizes, packing.step_groups(sizes, 8192)):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 512


def test_decontamination(spark):
    item = "Each morning Tom walks 5 km to the old mill and then Tom carries 12 bags of flour back to the village before noon."
    other = "A plain question about rivers, lakes and the colour of the deep sea at night in winter when the wind is still."
    new = item.replace("Tom", "Ann").replace("5 km", "9 miles").replace("12", "31")
    mixed = item.replace("Tom walks", "Ann walks").replace("then Tom", "then Bob")
    rows = [(1, "Intro words. " + item + " More."), (2, "Before that, here: " + new), (3, "So, " + mixed), (4, LONG), (5, None), (6, ""), (7, other.upper()), (8, "the old mill and then"), (9, item + "\n" + other), (1, "Intro words. " + item + " More."), (None, other)]
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2), (9, 1), (9, 2), (None, 2)}
    assert got[2, 1].n_exact < got[2, 1].n_hit and got[7, 2].n_hit == got[7, 2].n_windows
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), items, broadcast_rows=0).collect()} == set(got)
    assert sorted(r.doc_id for r in decontam.cleaned(docs_of(spark, rows), items).collect()) == [3, 4, 5, 6, 8]
    assert decontam.contaminated(docs_of(spark, rows).limit(0), items).count() == 0 == decontam.contaminated(docs_of(spark, rows), items.limit(0)).count()


def test_decontamination_of_numbers(spark):
    """Items made mostly of numbers, names and units are found word for word and, if their shape is whole, with other values."""
    texts = ["What is 12 + 7 * 3 - 4 + 19?", "Solve 3x + 12 = 27, 5y - 4 = 16, 2z + 9 = 31.", "Sort 14, 3, 27, 8, 91, 45, 62, 7 and 19.", "Mary has 3 kg, Tom has 2 kg, Ann has 4 kg, Bob has 7 kg."]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, "It was asked: " + t + " Nobody knew.") for i, t in enumerate(texts)]
    rows += [(10, "What is 11 + 6 * 2 - 5 + 18?"), (11, "Sort 15, 4, 28, 9, 92, 46, 63, 8 and 20."), (12, texts[3].replace("kg", "lb").replace("2", "5")), (13, "See 1, 2, 3, 4, 5, 6, 7, 8 and 9."), (14, "1 2 3 4 5 6 7 8 9 10 " * 50)]
    for limit in (0, 500_000):
        got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs_of(spark, rows), items, broadcast_rows=limit).collect()}
        assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (11, 2), (12, 3)}
        assert all(got[i, i].n_windows == got[i, i].n_hit == got[i, i].n_exact for i in range(4))


def test_decontamination_of_one_changed_value(spark):
    """A value at odds with its others leaves the exact windows of an occurrence standing."""
    item = "Each morning the miller walks 12 km to the old town and carries bags of flour back before noon, then rests a while and at last he walks another 12 km to the harbour."
    rows = [(1, item.replace("another 12", "another 13")), (2, item.replace("12 km to the harbour", "12 kilometers to the harbour")), (3, item.replace("12 km", "12 mi", 1).replace("old town", "old sea").replace("noon", "dusk").replace("a while", "a bit"))]
    got = {r.doc_id: r for r in decontam.contaminated(docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and all(2 * x.n_exact >= x.n_windows > x.n_hit for x in got.values())


def brute_lines(rows):
    at = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: -1 if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            at[key(x)].add(rank(i))
    gone = lambda i, x: len(key(x)) >= 40 and len(at[key(x)]) >= 5 and rank(i) < max(at[key(x)])
    return sorted((str(i), len((t or "").split("\n")), sum(gone(i, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


def test_line_dedup(spark, odd):
    r = random.Random(3)
    common = [("A line that very many documents hold %d " % k + "x" * 30)[: 40 + k] for k in range(6)] + ["\u00c9" * 40, "y" * 39]
    rows = odd + [(100 + i, "\n".join(r.choices(common, k=r.randint(0, 12)) + ["  " + common[0].upper() + "\t", "", words(r, 9)])) for i in range(300)]
    rows += [(100, rows[-300][1]), (None, common[0])]
    docs = docs_of(spark, rows).repartition(7)
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = line_dedup.applied(docs, line_dedup.keep_bitmaps(docs)).collect()
        assert sorted((str(x.doc_id), x._n_lines, x._n_dropped, x.text) for x in got) == brute_lines(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    empty = docs.limit(0)
    assert line_dedup.applied(empty, line_dedup.keep_bitmaps(empty)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_pii_base_spans():
    r = random.Random(11)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+44.20", "a.b@c.de", "x@y", "@", "é@é.com", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4", "9" * 60, "+", "DE89 3704 0044 0532 0130 00", " ", "\n", ".", "-", "a@b.c_d@e.fg", "12-", "555-123-4567"]
    for _ in range(3000):
        t = "".join(r.choices(bits, k=r.randint(0, 7)))
        assert [s[:3] for s in pii.spans(t) if s[2] in BASE] == brute_spans(t), t
    assert any(s[2] == "iban" for s in pii.spans("IBAN DE89 3704 0044 0532 0130 00."))
    assert [s[2] for s in pii.spans("SSN 219-09-9999 " + "x " * 30 + "serial 219-09-9998")] == ["national_id"]
    assert pii.redacted("mail a@b.cd now", [{"kind": "email", "start": 5, "end": 11}]) == "mail [EMAIL] now"


def test_pii_in_spark(spark, odd):
    got = pii.find(docs_of(spark, odd + [(50, "write to a@b.cd")]))
    assert got.count() == len(odd) + 1 and got.where("size(spans) > 0").first().doc_id == 50
    pii.spans("1" * 200_000 + "." * 200_000 + "a" * 200_000)  # ends soon


def test_chat_reads_back(spark):
    r = random.Random(2)
    bits = ["&", "&amp;", "<|", "<|im_end|>\n", "<|im_start|>user\n", "\n", "&lt;|", "\\", "é", "a", "<", "|>", ""]
    rows = [(c, t, random.Random(c + t).choice(["user", "assistant", "tool\n&<|", None]), None if c == 3 and t == 1 else "".join(r.choices(bits, k=5)), 9) for c in range(20) for t in range(c % 6 + 1)]
    rows += [(None, 0, "assistant", "hi", 1), (50, None, "user", "x", 1), (50, 1, "assistant", "y", 1), (50, 1, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    made = chat.examples(df)
    turns = {x.conv_id: [(t.role, t.text) for t in x.t] for x in made.where("last").select("conv_id", chat.turns_of(F.col("formatted")).alias("t")).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert turns == dict(want)
    replies = collections.defaultdict(list)
    for x in made.orderBy("conv_id", "example").select("conv_id", "mask_end", chat.reply_of(F.col("formatted"), F.col("mask_start"), F.col("mask_end")).alias("r")).collect():
        replies[x.conv_id] += [x.r] if x.mask_end else []
    assert {c: v for c, v in replies.items() if v} == {c: v for c, t in want.items() if (v := [x for role, x in t if role == "assistant"])}
    assert chat.examples(df.limit(0)).count() == 0


def test_quality(spark, odd):
    r = random.Random(4)
    rows = odd + [(200 + i, "\n".join(" ".join(r.choices(["a", "b", "#x", "é"], k=r.randint(0, 6))) for _ in range(20))) for i in range(60)]
    got = {(x.doc_id, x.n_words): x for x in quality.judged(docs_of(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        x = got[i, len(w)]
        assert (x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit))
        assert x.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (x.base_failed and x.kept)
    assert {x.doc_id for x in quality.marked(docs_of(spark, rows)).where("_kept").collect()} == {k[0] for k, x in got.items() if x.kept}
    assert quality.judged(docs_of(spark, rows).limit(0)).count() == 0


def test_quality_bands(spark):
    r = random.Random(8)
    noise = "".join(chr(r.randrange(33, 0x2FFF)) for _ in range(4000)) + " a b c" * 5 + " ".join(str(r.random()) for _ in range(60))
    prose = words(r, 400)
    got = {x.doc_id: x.kept for x in quality.judged(spark.createDataFrame([(1, prose), (2, noise), (3, "ab cd ef gh " * 300)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_records(spark, odd, tmp_path):
    path = queries.vocabulary("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = odd + [(60, "don't  stop\n\n now <|endoftext|> x  "), (59, "İ ½1 'S 's _a\u00a0 b")]
    folder = f"file://{tmp_path}/r"
    shards = records.write_records(docs_of(spark, rows).repartition(5), folder, path)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((str(i), start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    key = lambda x: (x[0], x[2], x[3])
    for seed in (None, 1):
        got = [(str(x.doc_id), x.start, x.n_tokens, bytes(x.ids)) for x in records.read_records(spark, folder, shards, seed).collect()]
        assert sorted(got) == sorted(want)
    assert records.write_records(docs_of(spark, rows).limit(0), f"{folder}2", path) == []
    raw = bytearray(records.frame(b"abc"))
    raw[13] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(raw))


def test_pipeline(spark, tmp_path):
    """All stages against plain Python, on a small corpus with planted copies, a shared line and a benchmark passage."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(21)
    item = " ".join(words(r, 1) for _ in range(30))
    shared = "This very long line stands in many of the documents here."
    rows = [(i, words(r, 120) + ("\n" + shared if i % 3 == 0 else ""), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[1][1], "en", "s", 0), (101, words(r, 60) + " " + item + " " + words(r, 40), "en", "s", 0), (102, "short", "en", "s", 0), (103, "ab cd ef " * 90, "en", "s", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    docs = [(i, t) for i, t, *_ in rows if t and quality.passes(t, compress)]
    docs = [(int(i), t) for i, _, _, t in brute_lines(docs)]
    ids = collections.defaultdict(list)
    for i, t in docs:
        ids[brute_fingerprint(t)].append(i)
    least = components(set(ids), ids)
    docs = [(i, t) for i, t in docs if least[brute_fingerprint(t)] == i and item not in t]
    assert {100, 101, 102, 103, 104}.isdisjoint(i for i, _ in docs) and len(docs) == 40
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in docs}
    got = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id].append(p)
    assert {i: b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start)) for i, ps in got.items()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_drops_near_copies(spark, tmp_path):
    """Copies with a few words changed go, those with many stay; a crowd of near copies leaves one."""
    import corpus_pipeline

    r = random.Random(33)
    base = [words(r, 200) for _ in range(21)]

    def changed(text, n):
        w = text.split()
        for i in range(n):
            w[15 + i * 180 // n] = "changed" + str(r.random())
        return " ".join(w)

    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, changed(t, 3)) for i, t in enumerate(base[:20])] + [(200 + i, changed(t, 12)) for i, t in enumerate(base[:20])]
    rows += [(300 + i, changed(base[20], 1)) for i in range(150)] + [(500, None), (501, ""), (None, base[0])]
    assert all(jaccard(t, dict(rows)[100 + i]) >= 0.8 > 0.6 > jaccard(t, dict(rows)[200 + i]) for i, t in enumerate(base[:20]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()) == [*range(21), *range(200, 220), 500]
    assert corpus_pipeline.near_dedup(spark, df.limit(0), str(tmp_path)).count() == 0
