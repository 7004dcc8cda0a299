"""Operators against brute force, round trips and held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemaloom.llm import _common, ann, html_text, langid, mixing, order_minhash, packing, simhash, substring_dedup, token_counts, warc, wordbpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, lang string, size long, n_words int, fingerprint string, score string"


def words(n, seed, base=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(base)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, shared passages, near copies."""
    passage = words(70, 1)
    near = words(300, 2)
    texts = [None, "", " \t\n", "one", "Two words", words(60, 3) + " " + passage, passage + "\n" + words(40, 4), words(5, 5) + "  " + passage[:-4], near, near + " tail", near.upper(), words(20_000, 6, 9000), "é" * 3000, "日本語 テキスト", "<|endoftext|> it's X'LL", passage, "123 456 !!"]
    rows = [(i, t, None if i % 5 == 4 else f"s{i % 3}", "en" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "other text", "s0", "en"), (None, words(80, 3), None, None), (None, None, None, None)]
    return [(*r, 7, 7, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(odd, empty, odd_rows):
    got = substring_dedup.remove_repeats(odd, length=50).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    least = {}
    for r in odd_rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            if r[0] is not None:
                least[tuple(w[i : i + 50])] = min(least.get(tuple(w[i : i + 50]), 1e9), r[0])
    want = []
    for r in odd_rows:
        w = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - 49):
            if r[0] is not None and least[tuple(w[i : i + 50])] < r[0]:
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        want.append((str(r[0]), str(r[1]), len(w), len(w) - len(kept), " ".join(kept)))
    assert sorted((str(g[0]), str(g[1]), *g[2:]) for g in got) == sorted(want)
    assert any(w[3] for w in want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(odd, empty, odd_rows):
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    comp = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {k: min((odd_rows[i][0] for i in range(len(fps)) if comp[i] == k and odd_rows[i][0] is not None), default=None) for k in set(comp)}
    want = sorted((str(odd_rows[i][0]), f"{fps[i]:016x}", str(least[comp[i]])) for i in range(len(fps)))
    got = simhash.simhash_groups(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((str(g[0]), g[1], str(g[2])) for g in got) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_links_at_three_bits(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = list(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = {tuple(x) for x in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        parent[find(a)] = find(b)
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                assert find(signed[i]) == find(signed[j])


def test_order_minhash(odd, empty, odd_rows):
    got = order_minhash.fingerprints_with_next(odd).collect()
    assert len(got) == len(odd_rows)
    ids = sorted([r for r in odd_rows if r[0] is not None and [x[0] for x in odd_rows].count(r[0]) == 1], key=lambda r: -r[0])
    by_id = {g.doc_id: g for g in got}
    for a, b in zip(ids, ids[1:]):
        if a[0] == b[0] + 1:
            text, after = a[1] or "", b[1] or ""
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert (by_id[a[0]].n_chars, by_id[a[0]].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert order_minhash.fingerprints_with_next(empty).count() == 0


def test_order_minhash_is_sensitive_to_order_and_edits():
    doc = words(600, 8)
    sign = lambda t: order_minhash.signature(order_minhash.kmers(order_minhash.points(t)))
    like = lambda t: order_minhash.likeness(sign(doc), sign(t))
    half = len(doc) // 2
    swapped = doc[half:] + doc[:half]
    few = doc[:100] + "X" + doc[101:]
    assert like(doc) == 1 and like(few) > 0.8 and like(few) > like(swapped) > like(words(600, 9)) - 1e-9
    assert like(swapped) < 0.8


def test_mixing(odd, empty, odd_rows):
    got = mixing.mix(odd)
    rows = got.select("doc_id", "size", "source", "source_size", "target", "taken", "position", "position_again").collect()
    assert len(rows) == len(odd_rows)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.taken > 0) == (r.position is not None or r.position_again is not None)
        assert r.position is None or 0 <= r.position <= 1
        by[r.source].append(r)
    for source, mine in by.items():
        assert sum(r.taken for r in mine) == int(mine[0].target) and sum(r.size for r in mine) == mine[0].source_size, source
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    order = [r.position for r in mixing.training_order(got).select("position").collect()]
    assert order == sorted(order) and mixing.mix(empty).count() == 0


def test_op4_is_in_training_order(spark, tmp_path):
    rows = [(i, words(5 + i % 40, i), f"s{i % 4}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    at = {r.doc_id: (r.position is None, r.position, r.position_again is None, r.position_again) for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    got = [tuple(9 if x is None else x for x in at[r.doc_id]) for r in mixing.op4(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and got == sorted(got) and {g[0] for g in got} == {True, False}


def test_token_counts(odd, empty, odd_rows):
    path = token_counts.tokenizer_path()
    library = wordbpe.WordBpe(path).library
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(odd, limit=20, store=True).collect()
    texts = {(r[0], r[1]) for r in odd_rows}
    assert len(got) == len(odd_rows)
    for g in got:
        text = next(t or "" for i, t in texts if i == g.doc_id and len((t or "").encode()) == g.n_bytes)
        assert g.n_tokens == count(text) and g.over_limit == (g.n_tokens > 20) and len(g.prefix_counts) == len(text) + 1
        for j in {0, len(text), *random.Random(1).sample(range(len(text) + 1), min(12, len(text) + 1))}:
            assert g.prefix_counts[j] == count(text[:j])
    assert token_counts.count_tokens(empty).count() == 0


def test_packing(odd, empty, odd_rows):
    library = wordbpe.WordBpe(token_counts.tokenizer_path()).library
    got = packing.pack(odd).collect()
    want = []
    for r in odd_rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(r[0]), i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted((str(g[0]), *g[1:5]) for g in got) == sorted(want)
    check_layout([(g.sequence_id, g.offset, g.length) for g in got])
    assert packing.pack(empty).count() == 0


def check_layout(placed):
    at = defaultdict(list)
    for s, o, n in placed:
        at[s].append((o, n))
    for mine in at.values():
        end = 0
        for o, n in sorted(mine):
            assert o == end
            end += n
        assert end <= 4096
    return len(at)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_tight(seed):
    r = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(4096, max(1, int(r.lognormvariate(6 + seed / 3, 1.1))))] += r.randint(1, 5)
    table = packing.plan(dict(histogram))
    placed, rank = [], defaultdict(int)
    for length, lo, hi, first, offset in table.tolist():
        assert lo == rank[length]
        rank[length] = hi
        placed += [(first + i, offset, length) for i in range(hi - lo)]
    assert dict(rank) == dict(histogram)
    used, total = check_layout(placed), sum(k * v for k, v in histogram.items())
    assert used <= max(-(-total // 4096), sum(v for k, v in histogram.items() if k > 2048)) * 1.03 + 1


def test_language_id(spark, empty):
    r = random.Random(4)
    parts = {"aa": "ka to mi ru se".split(), "bb": "sch ung ein der ich".split(), "cc": "tion ment eau que les".split()}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(60)), lang) for i, lang in enumerate(r.choices(list(parts), k=200))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !? 34", "cc"), (903, "katomi " * 20_000, None), (None, "schung", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g.held_out and g.doc_id < 900]
    assert held and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got if g.doc_id is not None)
    assert sum(g.lang_pred == g.lang for g in held) / len(held) > 0.98
    assert {g.doc_id: g.lang_pred for g in got if g.doc_id in (900, 901, 902, 903)} == {900: "und", 901: "und", 902: "und", 903: "aa"}
    assert all(0 <= g.score <= 1 for g in got) and langid.identify(empty).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((600, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [1.0]), (None, [1.0] * 24), (1080, [None] + [1.0] * 23), (3, x[3].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = defaultdict(dict)
    for g in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[g.query_id][g.rank] = (g.vec_id, g.score)
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, mine in got.items():
        score = np.append(x @ x[q], x[3] @ x[q])
        ids = np.append(np.arange(600), 3)
        score[q] = -np.inf
        order = np.lexsort((ids, -score))[:20]
        assert len(mine) == 20 and all(abs(x[v] @ x[q] - s) < 1e-9 for v, s in mine.values())
        hits += len({v for v, _ in mine.values()} & set(ids[order].tolist())) / len(set(ids[order].tolist()))
    assert hits / len(got) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 5 and ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "v", "a\r\n\r\nb" * 50_000), (None, "w", "<p>é</p>"), (2, "twice", "other"), (2, "twice", "other"), (6, "z", "other")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder = _common.scratch(spark, "warc")
    index = warc.write_archives(pages, folder)
    back = warc.read_archives(spark, index, folder).collect()
    assert len(back) == len(rows) and index.count() == len(rows)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", 1e9), page)
    want = []
    for page, _, html in rows:
        body = html or ""
        again = page != first[body]
        want.append((str(page), len(body.encode()), warc.sha1(body.encode()), "revisit" if again else "response", str(first[body] if again else None)))
    assert sorted((str(b.page_id), b.payload_bytes, b.payload_digest, b.record_type, str(b.refers_to)) for b in back) == sorted(want)
    assert {bytes(b.payload).decode() for b in back if b.record_type == "response"} == {h or "" for _, _, h in rows}
    none = warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(spark, none, folder).count() == 0


def test_html(spark):
    trees = html_text.model()
    pages = html_text.training_pages(120, seed=31)
    equal = 0
    for p in pages:
        marked = html_text.Page(p)
        want = "\n".join(t.replace("\u0001", "") for _, t, _ in marked.texts() if "\u0001" in t)
        equal += want == html_text.extract([p.replace("\u0001", "")], trees)[0]
    assert equal / len(pages) > 0.95
    page = '<html><body><nav><a href="/">Home</a> <a href="/b">B</a></nav><article><h1>A &amp; B</h1><p>First  one\n here.<br>Next<p>Second &eacute; <b>bold</b> text, long enough to read.</article><div class="comments"><p>I like it very much.</p></div><footer>&copy; X</footer>'
    rows = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<div>" * 2000 + "deep"), (1, page)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1] == "A & B\nFirst one here. Next\nSecond é bold text, long enough to read." and got[2] == got[3] == ""
    assert html_text.extract_text(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "curriculum_mix", "best_fit_packing"]
    docs = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars"))
    docs = docs.withColumn("lang", F.lit("en"))
    for name, stage in p.STAGES:
        docs = _common.spool(stage(spark, docs, ""), f"test-{name}")
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert set(ids) >= {3, 5, 11} and 0 not in ids  # the row without text and that without an id are one component
        if name != "best_fit_packing":
            assert tuple(docs.columns) == p.COLUMNS
    check_layout([(g.sequence_id, g.offset, g.length) for g in docs.collect()])


def brute_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup_keeps_one_document_of_each_component_at_exact_similarity(spark, empty):
    import corpus_pipeline as p

    r = random.Random(12)
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f"]

    def copy(base, edits):
        w = base.split()
        for i in r.sample(range(len(w)), edits):
            w[i] = f"x{r.randrange(10**6)}"
        return " ".join(w)

    for k in range(60):  # similarities from about 0.7 to 0.95 on both sides of the limit
        base = words(r.choice([40, 120, 400, 1500]), 1000 + k, 9000)
        n = len(base.split())
        texts += [base, *(copy(base, max(1, round(n * e))) for e in (0.005, 0.01, 0.02, 0.03))]
    hub = words(300, 99, 9000)  # copies that are near the first text and not each other, more than a key pairs with each other
    texts += [hub, *(copy(hub, 6) for _ in range(60))]
    r.shuffle(texts)
    sets = [brute_shingles(t) for t in texts]
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a == sets[j] or common and common >= 0.8 * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
                far += (simhash.fingerprint((texts[i] or "").encode()) ^ simhash.fingerprint((texts[j] or "").encode())).bit_count() > 3
    assert far > 50  # pairs that three bits of 64 leave
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars long")
    got = sorted(d.doc_id for d in p.near_dedup(spark, docs, "").collect())
    assert got == sorted({find(i) for i in range(len(texts))})
    assert p.near_dedup(spark, empty.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars")), "").count() == 0


def families(n, seed, shared=100, own=(18, 26)):
    """Texts in n families that have most of their words in common with all others; two of a family differ in a few words at one end."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(shared)]
    for k in range(n):
        mine = [f"f{k}w{i}" for i in range(r.randrange(*own))]
        for _ in range(2):
            tail = [f"t{r.randrange(10**9)}" for _ in range(r.randrange(8, 14))]
            yield " ".join(mine[:12] + common + mine[12:] + tail)


def test_near_dedup_loses_no_link_below_keys_of_many_texts(spark):
    import corpus_pipeline as p

    texts = list(families(150, 31))
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted({find(i) for i in range(len(texts))})
    assert 100 < len(want) < 250  # neither one component nor all apart
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars long")
    assert sorted(d.doc_id for d in p.near_dedup(spark, docs, "").collect()) == want


@pytest.mark.parametrize("block", [512, 3])
def test_exact_pairs_of_sets_are_complete(spark, monkeypatch, block):
    from schemaloom.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(8)
    base = [r.sample(range(10**6), r.choice([1, 4, 9, 30, 31, 80])) for _ in range(25)]
    sets = []
    for b in base:
        for _ in range(8):
            kept = r.sample(b, len(b) - r.randrange(len(b) // 4 + 1))
            sets.append(sorted({*kept, *r.sample(range(10**6), r.randrange(len(b) // 8 + 1)), *(range(3) if r.random() < 0.5 else ())}))
    roots = [r.randrange(40) for _ in sets]
    rows = spark.createDataFrame([(i, roots[i], s) for i, s in enumerate(sets)], "t bigint, root bigint, set array<bigint>")
    want = {(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    found = near_copies.exact_pairs(_common.spool(rows, "test-sets"))
    got = {(x.a, x.b) for x in near_copies._verified(found, rows.select("t", "set")).collect()}
    assert got == want and len(want) > 100


def test_near_dedup_keeps_rows_without_an_id_and_unlike_texts_of_one_id(spark):
    import corpus_pipeline as p

    rows = [(None, words(60, 1)), (5, words(60, 2)), (5, words(60, 3)), (None, words(60, 4)), (7, words(60, 4)), (None, words(60, 4)), (9, words(60, 2)), (5, words(60, 2))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars long")
    got = sorted((str(d.doc_id), d.text) for d in p.near_dedup(spark, docs, "").collect())
    assert got == sorted([("None", words(60, 1)), ("5", words(60, 2)), ("5", words(60, 3)), ("7", words(60, 4))])


def test_pipeline_of_an_empty_table(spark, empty):
    import corpus_pipeline as p

    docs = empty.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars"))
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_mixing_deals_rows_without_an_id_by_their_texts(spark):
    docs = spark.createDataFrame([(None, words(3 + i % 5, i), "s") for i in range(200)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs.withColumn("k", F.xxhash64("text"))).collect()
    again = {r.k: (r.taken, r.position, r.position_again) for r in mixing.mix(docs.repartition(3).withColumn("k", F.xxhash64("text"))).collect()}
    assert {r.k: (r.taken, r.position, r.position_again) for r in got} == again
    assert len({r.position for r in got if r.position is not None}) > 100


def plain_signature(text):
    """Order MinHash said plainly: numbered k-mers, the two least of each function by rank, in text order, hashed."""
    cp = order_minhash.points(text)
    n = len(cp)
    if not n:
        return [0] * order_minhash.SKETCHES
    k, top = min(order_minhash.K, n), 2**64
    seen, ids = defaultdict(int), []
    for i in range(n - k + 1):
        raw = sum(int(order_minhash.POINT_VALUES[x]) * pow(int(order_minhash.POINT_BASE), j, top) for j, x in enumerate(cp[i : i + k])) % top
        base = int(_common.mix(np.array([(raw + k) % top], np.uint64))[0])
        m = seen[base]
        seen[base] += 1
        ids.append(base if not m else int(_common.mix(np.array([(base + m * 0xD1B54A32D192ED03) % top], np.uint64))[0]))
    out = []
    for s in range(order_minhash.SKETCHES):
        order = sorted(range(len(ids)), key=lambda i: ((ids[i] >> 32) * int(order_minhash.MULTIPLIERS[s]) % 2**32, i))
        value = s + 1
        for i in sorted(order[: order_minhash.L]):
            value = int(_common.mix(np.array([(value * int(order_minhash.POINT_BASE) + ids[i]) % top], np.uint64))[0])
        out.append(value >> 48)
    return out


def test_order_minhash_equals_the_plain_version(spark):
    r = random.Random(21)
    texts = ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaa", "日本語" * 9, words(30, 5), "ab" * 40, *("".join(r.choice("abc ") for _ in range(n)) for n in (9, 10, 11, 12, 14, 50, 120))]
    plain = [plain_signature(t) for t in texts]
    for t, want in zip(texts, plain):
        assert order_minhash.signature(order_minhash.kmers(order_minhash.points(t))).tolist() == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {g.doc_id: g for g in order_minhash.fingerprints_with_next(docs).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    for i, text in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].fingerprint == "".join(f"{x:04x}" for x in plain[i])
        assert (got[i].near_edited, got[i].near_next) == (like(plain[i], plain_signature(edited)), like(plain[i], plain_signature(after)))


def test_order_minhash_of_many_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, words(5, i)) for i in range(400)], "doc_id bigint, text string")
    got = order_minhash.fingerprints_with_next(docs).collect()
    assert len(got) == 400 and sum(g.doc_id is None for g in got) == 200


def test_substring_dedup_of_repeated_rows_costs_as_much_as_of_others(spark):
    base, other = words(400, 50, 10**6), words(300, 51, 10**6)
    rows = [(1, base), *[(2, other[:500] + " " + base[:1500] + " tail")] * 1500]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    n = len(base[:1500].split())
    assert {(g.doc_id, g["count"]) for g in got} == {(1, 1), (2, 1500)}
    assert {g.n_removed for g in got if g.doc_id == 2} <= {n - 1, n} and {g.n_removed for g in got if g.doc_id == 1} == {0}


def blocks_of(page):
    return [t for _, t, _ in html_text.Page(page).texts()]


def test_odd_markup():
    assert blocks_of('<p class="a"">text</p>') == ["text"]
    assert blocks_of("<head><title>T</title><body><header>H</header><p>x") == ["H", "x"]
    assert blocks_of("<p>so <math><mi>x</mi>+<mi>y</mi>=<mi>z</mi><annotation>tex</annotation></math> holds") == ["so x+y=z holds"]
    assert blocks_of("<p>a <object data=x><b>b</b></object> <noscript>c <i>d</i></noscript> e") == ["a b c d e"]
    assert blocks_of("<svg><svg><text>q</text></svg></svg>after") == ["after"]
    assert blocks_of("<svg>unended <p>p") == ["unended", "p"]
    assert blocks_of("<script>'</scripty>'</script >t") == ["t"]
    assert blocks_of('<a title = "x > y">l</a><!-->m<!-- q -->n') == ["lmn"]
    assert blocks_of("1 <2 and a <b") == ["1 <2 and a <b"]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 350_000 + ">", '<a b=">" ' * 120_000, "<div>" * 100_000 + "</p>" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<svg>" * 100_000, "<svg>" + "<svg " * 200_000, "<b>" * 100_000 + "<p>" * 100_000, "<" * 1_000_000, "<a><p>" * 100_000])
def test_parsing_is_linear(page):
    import time

    began = time.time()
    html_text.Page(page).texts()
    assert time.time() - began < 10


def test_siblings_of_one_kind_are_counted_in_wide_containers():
    page = html_text.Page("<div><h1>t</h1>" + "<p>x</p>" * 100 + "</div>")
    x = html_text.features(page, page.texts())
    same = len(html_text.KINDS) + 7 + 3
    assert x[2, same] == 1 and x[3, same] == 100


def plain_distance(text, model):
    """Out-of-place distance said plainly."""
    langs, grams, ranks = model
    found = defaultdict(int)
    letters = langid._letters()
    for word in re.findall("[a-z]+", text.lower()):
        codes = [int(letters[ord(ch)]) for ch in word]
        padded = [0, *codes, 0]
        for x in codes:
            found[1 << 3 * langid.BITS | x] += 1
        for a, b in zip(padded, padded[1:]):
            if b:
                found[2 << 3 * langid.BITS | a << langid.BITS | b] += 1
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            found[3 << 3 * langid.BITS | a << 2 * langid.BITS | b << langid.BITS | c] += 1
    top = sorted(found, key=lambda g: (-found[g], g))[: langid.DOCUMENT_GRAMS]
    place = {int(g): i for i, g in enumerate(grams)}
    out = []
    for k in range(len(langs)):
        out.append(sum(langid.LANGUAGE_GRAMS if g not in place or ranks[place[g], k] == langid.LANGUAGE_GRAMS else abs(int(ranks[place[g], k]) - i) for i, g in enumerate(top)))
    return out, len(top)


def test_distances_equal_the_plain_version(spark):
    r = random.Random(8)
    syllables = {"aa": "ka to mi ru se".split(), "bb": "sch ung ein der ich".split()}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for text in [make("aa", 1), make("aa", 60), make("bb", 300), make("aa", 9) + " " + make("bb", 9)]:
        raw = text.encode()
        cost, n, has = langid.distances(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert (cost[0].tolist(), n[0]) == plain_distance(text, model) and has[0]


def test_scripts_do_not_share_letters():
    letters = langid._letters()
    assert letters[0x430] == letters[0x410] == 0x430 and letters[0x6F22] == 0x6F22 and letters[0x20000] == 0x20000
    every = np.array([p for p in range(1 << langid.BITS) if letters[p] == p and p], np.uint32)
    text = every.astype("<u4").tobytes().decode("utf-32-le")
    raw = [text.encode(), "漢字 и буквы".encode(), b"plain"] * 3
    at = np.cumsum([0, *(len(x) for x in raw)])
    row, gram, count, has = langid.gram_counts(np.frombuffer(b"".join(raw), np.uint8), at)  # more letters than fit beside the rows
    assert has.all() and len(np.unique(gram[row == 0])) == (row == 0).sum() and (row == 0).sum() == (row == 3).sum()
    alone = langid.gram_counts(np.frombuffer(raw[1], np.uint8), np.array([0, len(raw[1])]))
    assert gram[row == 7].tolist() == alone[1].tolist() and count[row == 7].tolist() == alone[2].tolist()


def test_nearest_of_repeated_ids_and_rows(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((80, 16))
    rows = [(i, v.tolist(), "clash", 7) for i, v in enumerate(x)]
    rows += [(20, x[70].tolist(), "clash", 7), (40, x[40].tolist(), "clash", 7)]  # another vector of id 20; row 40 twice
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string, rank int")
    got = defaultdict(list)
    for g in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got[g.query_id].append((g.rank, g.vec_id, round(g.score, 9)))
    vectors = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    for q in (0, 20, 40, 60):
        want = []
        for i in np.flatnonzero(ids == q):
            score = vectors @ vectors[i]
            score[i] = -np.inf  # its own row alone
            order = np.lexsort((ids, -score))[:5]
            want += [(n + 1, int(ids[j]), round(float(score[j]), 9)) for n, j in enumerate(order)]
        assert sorted(got[q]) == sorted(want)


def test_language_stage_rejects_what_is_like_no_learned_language(spark):
    import corpus_pipeline as p

    r = random.Random(14)
    syllables = {"aa": "ka to mi ru se no".split(), "bb": "sch ung ein der ich ver".split()}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, r.choice([3, 10, 80])), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    odd = [(1000, " ".join("".join(r.choice("qwxzjypf") for _ in range(6)) for _ in range(60)), None), (1001, "Это не тот язык", None), (1002, "12 34", "aa"), (1003, None, "aa"), (None, make("aa", 40), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows + odd], "doc_id bigint, text string, lang string, source string, n_chars long")
    kept = {d.doc_id for d in p.language_id(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows} | {None}


def test_decoding_equals_trying_all_labellings():
    import itertools

    r = np.random.default_rng(9)
    for n in (2, 4, 7, 9):
        for _ in range(20):
            parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
            margin = r.normal(0, 2, n)
            margin[r.random(n) < 0.2] = 0
            best = -np.inf
            for rest in itertools.product((False, True), repeat=n - 1):
                keep = (True, *rest)
                if all(keep[parent[i]] or not keep[i] for i in range(1, n)):
                    best = max(best, sum(-np.logaddexp(0, -m if k else m) for m, k in zip(margin, keep)))
            got = html_text.decode(parent, margin)
            assert got[0] and all(got[parent[i]] or not got[i] for i in range(1, n))
            assert sum(-np.logaddexp(0, -m if k else m) for m, k in zip(margin, got)) == pytest.approx(best)


def test_targets_of_many_sources_equal_plain_water_filling(spark):
    r = random.Random(10)
    sizes = {f"s{i:04d}": r.choice([0, 1, 5, 40, 1000, 90_000]) for i in range(300)} | {None: 77}
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:  # sources above their cap are fixed there, the rest is shared anew
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 2 * sizes[k]]
        if not over:
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            free.remove(k)
    target |= {k: level * weight[k] for k in free}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(7)
    got = {g.source: g for g in mixing.source_targets(rows).collect()}
    assert len(got) == len(sizes) and {k: g.weight for k, g in got.items()} == weight
    for k, g in got.items():
        assert g.target == pytest.approx(target[k]), k


def test_running_sums_over_ranges(spark):
    rows = [(i % 50, i, i * 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, v bigint").repartition(5)
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[b] = total
        total += v
    assert {g.b: g.s for g in mixing.running(df, [F.col("a").asc(), F.col("b").asc()], s=F.col("v")).collect()} == want


def sequences_of(table):
    return len({first + i for _, lo, hi, first, _ in table.tolist() for i in range(hi - lo)})


def test_configurations_follow_the_programme():
    assert sequences_of(packing.plan({2000: 1200, 1100: 1200, 996: 1200})) == 1200  # 2000 + 1100 + 996, though 2000 + 2000 comes first
    r, histogram = random.Random(1), defaultdict(int)
    for _ in range(20_000):
        histogram[min(4096, max(1, int(r.lognormvariate(7.3, 0.2))))] += 1
    assert sequences_of(packing.plan(histogram)) < 7900  # some 8,470 if the largest sizes are completed one after the other
