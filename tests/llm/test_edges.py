"""Extreme ids, long texts, hostile pages, and plain versions of what the operators compute in arrays."""

import hashlib
import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_duplicates import brute_components, brute_removal
from tests.llm.test_media import _scalar_image
from tidemark.llm import bpe, html, jaccard, jpeg, language, media, preferences, quality, shared, suffixes, urls


def test_preferences_of_any_ids(spark):
    """Ids beyond 2**53 and below zero, ties of a turn number, null answers, numbers, roles and ids."""
    big = 2**53
    turns = [(k, t, r, f"{k}{t}{r}") for k in (big, big + 1, big + 2, big + 3, -1, -2, -3) for t, r in ((0, "user"), (1, "assistant"), (2, "assistant"))]
    turns += [(8, 0, "user", "q"), (8, 1, "assistant", "a"), (8, 1, "assistant", "b"), (8, 1, "assistant", None), (8, 2, "assistant", "c"), (8, None, "user", "x"), (9, 1, None, None), (9, 1, "assistant", None), (9, 2, "assistant", "z"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    names = "pair_id n_common prompt chosen rejected chosen_mask rejected_mask".split()
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({preferences.SQL})").fetchall())
    got = sorted(tuple(r[n] for n in names) for r in preferences.conversation_preferences(df).collect())
    assert got == want
    pairs = {r[0] for r in got}
    assert {f"n{big // 2}", f"n{big // 2 + 1}", "n-1", "n-2", "n4"} <= pairs and len([p for p in pairs if p[0] == "n"]) == 5


def test_links_of_any_ids_and_long_texts(spark):
    """Negative ids, and ten near copies of a long text among others that share its words."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(10):
        words = list(base)
        for _ in range(40 * (i + 1)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
        rows.append((-1 - i, " ".join(words)))
    rows += [(i, " ".join(base[300 * i : 300 * i + 600])) for i in range(12)] + [(100 + i, " ".join(base[10:400])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute_components(rows)


def test_signatures_grow_with_the_set_not_its_square():
    sizes = []
    for n in (2_000, 20_000, 200_000):
        prefix = n // 5 + 1 + jaccard._classes(n)
        sizes.append(prefix * prefix / (2 * jaccard._classes(n)) / n)
    assert max(sizes) < 2 * min(sizes) and max(sizes) < 2


def test_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rnd = random.Random(19)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rnd.randrange(0, 9)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_keys_that_hold_most_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"k{i % 7}") for i in range(90)], "doc_id long, key string")
    classes = rows.groupBy("key").agg({"doc_id": "min", "*": "count"}).withColumnsRenamed({"min(doc_id)": "rep", "count(1)": "count"})
    got = {r.doc_id: r.rep for r in shared.join_by_class(rows, classes, "key", 90, parts=4).collect()}
    assert len(got) == 90 and all(got[i] == 1 for i in range(90) if i % 3)


def test_removal_with_repeated_rows(spark, rows):
    some = [(i - 5, t) for i, t, *_ in rows if not t or len(t) < 5000]
    df = spark.createDataFrame(some + some[:30] + [(None, some[0][1])], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()}
    assert got.pop(None)[1] == 0 and got == brute_removal(some)
    assert suffixes.remove_repeats(df).count() == len(some) + 1


def test_language_stage_follows_the_prediction(spark, docs, rows):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = language.train(plain)
    names, scores = model.predict([r[1] for r in rows])
    want = {r[0]: n for r, n, s in zip(rows, names, scores) if n != "und" and s > language.MIN_SCORE}
    assert {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, plain, "").collect()} == want


def test_texts_that_no_classifier_claims_go(spark):
    rnd = random.Random(2)
    parts = {"en": "the of and ing tion whe tha ere".split(), "de": "der die und sch ung keit ein ver".split(), "fr": "le la et eau oux ment que".split(), "es": "el los cion mente ado para".split()}
    rows = [(i, " ".join("".join(rnd.choices(parts[l], k=2)) for _ in range(30)), l) for i, l in enumerate(list(parts) * 50)]
    rows += [(1000, "дом у реки стоит в саду и свет падает на камни", None), (1001, "漢字仮名交じり文", None)]
    got = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in got.collect()} - {1000} == set(range(200))


def test_kernel_and_ridge_equal_dense_algebra():
    rnd = random.Random(8)
    texts = [(l, "".join(rnd.choices(a, k=60))) for _ in range(30) for l, a in (("x", "abcdef "), ("y", "defghi "), ("z", "ghijkl "))]
    model = language.fit([(l, language.ngrams(t)) for l, t in texts], per_language=5)
    sets = [set(np.flatnonzero(language.ngrams(t))) for _, t in texts]
    first = [i for l in model.languages for i in [k for k, (m, _) in enumerate(texts) if m == l][:5]]
    first.sort()
    plain = np.array([[len(a & sets[j]) / np.sqrt(len(a) * len(sets[j])) for j in first] for a in sets])
    assert np.allclose(model.kernel([language.ngrams(t) for _, t in texts]), plain, atol=1e-5)
    target = np.array([[1.0 if l == m else -1.0 for m in model.languages] for l, _ in texts])
    inner = plain[first]
    alpha = np.linalg.solve(plain.T @ plain + 1e-2 * len(texts) / 100 * inner, plain.T @ target)
    assert np.allclose(plain @ model.coefficients, plain @ alpha, atol=1e-2)


def test_pages_are_read_in_one_pass():
    hostile = ["<a " * 60_000, "<!" * 100_000, '<a x="' * 60_000, "<div>" * 30_000 + "</b>" * 30_000, "<div class=ad>" * 30_000, "</p>" * 30_000 + "<div>" * 30_000 + "</p>" * 30_000]
    for page in hostile:
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 5


def plain_classify(found):
    """The block rules, block by block, without running state."""
    share = lambda texts: (lambda w: sum(x in html.STOP_WORDS for x in w) / max(1, len(w)))([x.lower() for t in texts for x in html.WORD.findall(t)])
    body = [b.text for b in found if not b.furniture and len(b.text) >= 70 and b.links <= 0.2 * len(b.text)]
    foreign = share(body) < 0.1
    marks, of_links = [], []
    for i, b in enumerate(found):
        mostly = [x.content and not x.furniture and not x.heading and 2 * x.links > len(x.text) for x in found]
        linked = b.links > 0.2 * len(b.text) if not b.content else mostly[i] and (i > 0 and mostly[i - 1] or i + 1 < len(found) and mostly[i + 1])
        dense = 0.2 if foreign else share([b.text])
        of_links.append(linked)
        if b.furniture or linked:
            marks.append(False)
        elif len(b.text) < 70:
            marks.append(None)
        elif b.content:
            marks.append(True if dense >= 0.1 else None)
        else:
            marks.append(True if dense >= 0.2 and len(b.text) >= 200 else None if dense >= 0.1 else False)
    out = []
    for i, b in enumerate(found):
        decided = [k for k, m in enumerate(marks) if m is not None and not found[k].furniture]
        above, below = max((k for k in decided if k < i), default=-1), min((k for k in decided if k > i), default=len(found))
        label = lambda k: 0 <= k < len(found) and marks[k]
        if marks[i] is not None:
            out.append(marks[i])
        elif all(found[k].furniture or of_links[k] for k, m in enumerate(marks) if m is not None):
            out.append(True)
        elif b.content:
            near = [label(k) for k in (above, below) if 0 <= k < len(found) and found[k].content]
            out.append(not near or any(near))
        elif label(above) == label(below):
            out.append(label(above))
        else:
            out.append(label(above) if i - above <= below - i and not b.heading else label(below))
    return out


def test_block_rules_equal_a_plain_version():
    rnd = random.Random(6)
    words = "the of and to house river stone garden light winter paper market".split()
    for _ in range(300):
        found = []
        for _ in range(rnd.randrange(0, 14)):
            vocabulary = words if rnd.random() < 0.6 else words[4:]
            text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([2, 8, 20, 60])))
            found.append(html.Block(text, rnd.choice([0, 0, 0, len(text) // 4, len(text)]), rnd.random() < 0.1, rnd.random() < 0.4, rnd.random() < 0.15))
        assert html.classify(found) == plain_classify(found)


def _posterior(pages, labels):
    """Upper bound of each host, level by level in plain Python."""
    def level(host):
        name = host.rpartition("@")[2]
        name = name.rpartition(":")[0] if name.rpartition(":")[2].isdigit() and ":" in name else name
        parts = name.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            return name, ""
        k = 2 if ".".join(parts[-2:]) in urls.SUFFIXES else 1
        return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])

    good = {i: int(q == 1 and t == 0) for i, q, t in labels}
    count: dict = {}
    for i, host in pages:
        n, y = count.get(host, (0, 0))
        count[host] = (n + (i in good), y + good.get(i, 0))
    domains, suffix = {}, {}
    for host, (n, y) in count.items():
        for table, key in ((domains, level(host)), (suffix, level(host)[1])):
            a, b = table.get(key, (0, 0))
            table[key] = (a + n, b + y)

    def strength(table):
        rows = [r for r in table.values() if r[0]]
        j, n, y = len(rows), sum(r[0] for r in rows), sum(r[1] for r in rows)
        mean = y / n if n else 0.5
        if j < 2 or n <= j:
            return 1000.0, mean
        yy, nn = sum(b * b / a for a, b in rows), sum(a * a for a, _ in rows)
        msb, msw, n0 = (yy - y * y / n) / (j - 1), (y - yy) / (n - j), (n - nn / n) / (j - 1)
        if msb + (n0 - 1) * msw <= 0 or msb <= msw:
            return 1000.0, mean
        return max(1.0, min(1000.0, (msb + (n0 - 1) * msw) / (msb - msw) - 1)), mean

    (ks, top), (kd, _), (kh, _) = strength(suffix), strength(domains), strength(count)
    out = {}
    for host, (n, y) in count.items():
        sn, sy = suffix[level(host)[1]]
        dn, dy = domains[level(host)]
        m = (dy + kd * (sy + ks * top) / (sn + ks)) / (dn + kd)
        a, b = y + kh * m, n - y + kh * (1 - m)
        out[host] = a / (a + b) + 2 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


def test_reputation_equals_a_plain_posterior(spark):
    rnd = random.Random(12)
    hosts = ["a.one.co.uk", "b.one.co.uk", "two.co.uk", "x.bad.com", "y.bad.com:8080", "user@z.bad.com", "10.0.0.1", "10.0.0.2:80", "good.fr", "co.uk", "lone"]
    pages = [(i, h) for i, h in enumerate(rnd.choice(hosts) for _ in range(500))]
    labels = [(i, int(rnd.random() < (0.1 if "bad" in h or h == "10.0.0.1" else 0.8)), 0) for i, h in pages if i % 3]
    df = spark.createDataFrame([(i, f"http://{h}/p", "x", 1.0) for i, h in pages], "page_id long, url string, suffix string, n double")
    got = {r.host: r.verdict for r in urls.judge_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = _posterior(pages, labels)
    assert got == {h: "block" if v < urls.MIN_GOOD else "allow" for h, v in want.items()} and set(got.values()) == {"block", "allow"}


def test_colours_and_chroma_against_a_plain_decoder():
    rng = np.random.default_rng(4)
    w, h, samp = 33, 19, (2, 2)
    across, down = -(-w // 16), -(-h // 16)
    coefs = [np.where(rng.random((down * s[1], across * s[0], 64)) < 0.1, rng.integers(-5, 6, (down * s[1], across * s[0], 64)), 0) for s in (samp, (1, 1), (1, 1))]
    own = [(-(-w // 8), -(-h // 8)), (across, down), (across, down)]
    for c, (x, y) in zip(coefs, own):
        c[y:, :, 1:] = 0
        c[:, x:, 1:] = 0
    image, _ = _scalar_image(coefs, w, h, samp)
    _, [[rgb]] = jpeg.decode([image])
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    planes = []
    for c, s in zip(coefs, (samp, (1, 1), (1, 1))):
        plane = np.zeros((c.shape[0] * 8, c.shape[1] * 8))
        for y in range(c.shape[0]):
            for x in range(c.shape[1]):
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = c[y, x] * np.arange(1, 65)
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.rint(basis.T @ block.reshape(8, 8) @ basis + 128), 0, 255)
        planes.append(np.kron(plane, np.ones((2 // s[1], 2 // s[0])))[:h, :w])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    exact = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
    assert np.abs(rgb - exact).max() <= 3 and np.abs(rgb - exact).mean() < 0.6


def test_long_texts_as_several_images(spark):
    text = "".join(chr(random.Random(1).randrange(32, 0x2FF)) for _ in range(10)) * 120_000
    r = media.documents_as_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = media.payload(text)
    assert r.payload_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.feature.split(":")[0].count("+") >= 2
    [form] = jpeg.encode([raw])
    assert hashlib.sha256(form).hexdigest() == r.media_sha256 and b"".join(media.images_of(form)) == form


def test_quality_of_long_and_no_texts(spark, nothing):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(9000)}" for _ in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(words), "en"), (None, "again and again and " * 30, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    assert got[1].n_words == 30_000 and got[1].n_repeat_words == len(again) and got[None].base_failed
    assert quality.quality_rules(nothing).count() == quality.keep_good(nothing).count() == 0
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [k for k, r in got.items() if r.kept]


def test_intermediate_tables_go(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 2000")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    place = Path(shared.shared_folder(spark).removeprefix("file:"))
    with shared.run_folder(spark) as other:  # of another run
        mine = shared.written(spark.range(3))
        with ThreadPoolExecutor(1) as pool:
            before = set(place.iterdir())
            pool.submit(corpus_pipeline.run, spark, str(tmp_path)).result()
        left = set(place.iterdir()) - before
        assert [p.name.startswith("pipeline-") for p in left] == [True] and mine.count() == 3 and Path(other).exists()
    assert not Path(other).exists()


def test_names_of_other_columns_never_clash(spark, docs, rows):
    """Columns named as the stages' own, whatever their case."""
    names = ["_id", "_Sha", "_spans", "_none", "row", "spans", "sha", "key"]
    clashing = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (suffixes.cut_repeats, quality.keep_good, lambda d: corpus_pipeline.ngram_jaccard(spark, d, ""), lambda d: corpus_pipeline.language_id(spark, d, "")):
        got = stage(clashing)
        assert got.columns == clashing.columns
        found = got.collect()
        assert {tuple(r)[:5] for r in found} == {tuple(r) for r in stage(plain).collect()}
        assert {tuple(r)[5:] for r in found} == {tuple(f"v{i}" for i in range(len(names)))}


@pytest.mark.parametrize("text", ["", "a", "word " * 50, "é" * 40, "x" * 200])
def test_pieces_side_by_side(text):
    import public_tokenizers as P

    find = bpe.pieces_pattern(P.PATTERN).findall
    keys = [" a", " b\n", " " + text, "first", " ", " \n", " 12", " don't"]
    assert bpe._pieces(keys, find) == [find(k) for k in keys]
