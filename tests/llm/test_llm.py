"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import tiktoken

from palimpsest.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality, queries, shared, token_counts, token_files, word_bpe
from palimpsest.llm.shared import Workspace, components, only_hits

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
ROWS = [(1, "Hello wörld, hello", "a"), (2, None, None), (3, "", "b"), (4, LONG, "a"), (5, "Hello wörld, hello", "a"), (5, "Hello wörld, hello", "a"), (None, "x  y\n\n z ", "b"), (7, " \t\n", None), (8, "hELLO wörld, hello", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en", 9, 1.0, "h") for i, t, s in ROWS], "doc_id long, text string, source string, lang string, n long, score double, h string")


@pytest.fixture(scope="module")
def work(spark):
    return Workspace(spark, "test")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])


def test_pieces_are_what_the_library_gives():
    ids, counts = (bpe.load(bpe.vocabulary("byte_bpe_50k.json"), c) for c in (False, True))
    rng = random.Random(5)
    texts = ["", " ", "a <|endoftext|> b", "it's he'll", "a\x1c b", *["".join(rng.choice(" \n\tab'sé.<|endoftext|>1漢,()-\x1f") for _ in range(rng.randint(1, 60))) for _ in range(500)]]
    for t in texts:
        want = ids.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(t), ids.code).tolist() == want
        assert counts.encode(t) == len(want)
        cut = list(token_counts.parts(t * 3, 7))
        assert "".join(cut) == t * 3
        assert sum(map(counts.encode, cut)) == len(ids.tokenizer.encode(t * 3, add_special_tokens=False))


def test_counts(docs):
    t = bpe.load(bpe.vocabulary("byte_bpe_50k.json")).tokenizer
    got = token_counts.count_tokens(docs, bpe.vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512)) for i, x, _ in ROWS)
    assert token_counts.count_tokens(docs.limit(0), bpe.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_those_of_any_file(spark, file):
    texts = [x for (x,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:120] + ["  a\n\n b ", " ", "<|endoftext|> x", "Don't"]
    path = bpe.vocabulary(file)
    if file.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    else:
        import sentencepiece

        want = [sentencepiece.SentencePieceProcessor(model_file=path).encode(x or "") for x in texts]
    for most in (50, 1 << 20):
        old, token_counts.BATCH_BYTES = token_counts.BATCH_BYTES, most
        assert token_counts.counted(bpe.load(path, counting=True), [x or "" for x in texts]) == [len(x) for x in want]
        token_counts.BATCH_BYTES = old
    e = bpe.load(path)
    assert [np.frombuffer(e.encode(x or ""), e.code).tolist() for x in texts] == want


def test_blocks():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50000, (3, 1024)), rng.integers(0, 1 << 32, (2, 1024)), np.full((1, 5), 7), np.array([[1] * 1000 + [4_000_000_000] * 24])):
        ids = ids.astype(np.uint32)
        for row, data in zip(ids, token_files.pack_blocks(ids), strict=True):
            assert (token_files.unpack_block(b"xx" + data, 2, len(row)) == row).all()


def test_token_files(spark, docs):
    t = bpe.load(bpe.vocabulary("byte_bpe_50k.json")).tokenizer
    got = token_files.read_files(token_files.write_files(docs, bpe.vocabulary("byte_bpe_50k.json"), Workspace(spark, "t2"))).orderBy("start").collect()
    want, start = [], 0
    for i, x, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.read_files(token_files.write_files(docs.limit(0), bpe.vocabulary("byte_bpe_50k.json"), Workspace(spark, "t2e"))).count() == 0


def test_exact(spark, docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, Workspace(spark, "t3"), keep="largest").collect()}
    assert got == {(1, 8, 4, False), (5, 8, 4, False), (8, 8, 4, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (None, None, 1, True), (7, 7, 1, True)}
    assert exact_dedup.dedup(docs.limit(0), Workspace(spark, "t3e")).count() == 0


def test_lower_case_of_other_letters(spark):
    text = "".join(map(chr, [*range(32, 0xD800), *range(0xE000, 0x11000)]))
    odd = [text[k : k + 50] for k in range(0, len(text), 50)]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(exact_dedup.normalised(mixing.F.col("t"))).collect()
    assert [r[0] for r in got] == [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in odd]


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, Workspace(spark, "t4")).collect() if r.doc_id}
    assert got == {1: (1, 1), 5: (1, 1), 8: (1, 1), 2: (0, 2), 3: (0, 3), 7: (0, 7), 4: (1, 4)}
    assert jaccard_join.jaccard_components(docs.limit(0), Workspace(spark, "t4e")).count() == 0


def varied(rng, n):
    """Texts that are cut, lengthened and substituted, from one word up."""
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 30, 60]))] for _ in range(n // 6)]
    out = []
    for k in range(n):
        w = list(base[k % len(base)])
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            match rng.randint(0, 3):
                case 0:
                    w[at] = f"x{rng.randint(0, 9)}"
                case 1:
                    w.append(f"x{rng.randint(0, 9)}")
                case 2:
                    w.insert(0, f"x{rng.randint(0, 9)}")
                case _:
                    w = w[: max(1, len(w) - 1)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [None, 0, 5, 12])
def test_jaccard_against_brute_force(spark, small):
    rows = list(enumerate(varied(random.Random(2), 240)))
    df = spark.createDataFrame([(f"k{i:04}", t, i) for i, t in rows], "doc_id string, text string, n long")  # keys that aren't integers, and a clashing name
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, Workspace(spark, "t4b"), small=small).collect()}
    assert got == {f"k{k:04}": (n, f"k{c:04}") for k, (n, c) in brute.jaccard(rows).items()}


def test_long_lists_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 3)
    rng = random.Random(9)
    body = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(body[: rng.randint(20, 60)] + [f"own{k}x{i}" for i in range(rng.randint(0, 25))])) for k in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t4c")).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_of_small_hubs_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for size in [*[7, 8] * 25, *range(6, 13)]:  # most are so small that subsets are keys, and extensions link with their hub only
        hub = [word() for _ in range(size)]
        texts += [" ".join(hub), *(" ".join([*hub, word()] if j % 2 else [word(), *hub]) for j in range(6))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, Workspace(spark, "t4h")).collect()}
    assert got == brute.jaccard(list(enumerate(texts)))


def test_lines(spark, docs):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(3))
    more = spark.createDataFrame([(10, f"own\n{run}\nend"), (11, f"{run}"), (12, f"a\n{run}\nb"), (13, run.split("\n")[0])], "doc_id long, text string")
    got = {r.doc_id: (r["__gone"], r["__left"], r.text) for r in line_dedup.dedup_lines(docs.unionByName(more, True), Workspace(spark, "t5")).collect()}
    assert got[10][:2] == (0, True) and got[11] == (3, False, "") and got[12] == (3, True, "a\nb") and got[13][0] == 0
    assert got[2] == (0, True, None) and got[4][2] == LONG
    assert line_dedup.dedup_lines(docs.limit(0), Workspace(spark, "t5e")).count() == 0


def test_lines_of_any_length_keys_and_names(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a b", "c", "", "d e f", "g", "h i"]) for _ in range(rng.randint(1, 9)))) for k in range(60)]
    for least in (1, 3, 6):
        df = spark.createDataFrame([(f"{k:03}", t, 1, 2, 3, 4) for k, t in rows], "doc_id string, text string, __at int, k int, __map int, other int")
        got = line_dedup.dedup_lines(df, Workspace(spark, "t5k"), min_words=least).collect()
        assert {int(r.doc_id): r.text if r["__left"] else None for r in got} == brute.lines(rows, least)
        assert all((r["__at"], r.k, r["__map"], r.other) == (1, 2, 3, 4) for r in got)


def multi_encoding():
    import public_tokenizers as p

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words(spark, docs, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 50_000)
    t = multi_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := t.encode_ordinary(x or "")), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())) for i, x, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.multi(docs.repartition(3)).collect()) == want
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: sha(",".join(map(str, t.encode_ordinary(r.text or ""))).encode()) for r in all_.collect()}
    assert {r.doc_id: r.ids_sha256 for r in word_bpe.multi(all_).collect()} == want
    assert word_bpe.multi(docs.limit(0)).count() == 0


def test_mix(spark, docs):
    got = mixing.mix(docs, Workspace(spark, "t8"))
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in ("a", "b", None):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
    assert mixing.mix(docs.limit(0), Workspace(spark, "t8e")).count() == 0


def test_mixed_texts_are_whole(spark, docs):
    mixed = mixing.mix(docs, w := Workspace(spark, "t8w"))
    rows = w.write(mixed, "mixed").collect()
    assert any(r.taken % r.size for r in rows if r.size)  # one is taken in part
    got = [(r.doc_id, r.text) for r in mixing.mixed_texts(docs, w.write(mixed, "again"), w).collect()]
    text = {i: x for i, x, _ in ROWS}
    assert all(x == text[i] for i, x in got)
    # all that is taken comes, once for each time begun
    assert {i for i, _ in got} == {r.id for r in rows if r.taken} and len(got) == sum(-(-r.taken // r.size) for r in rows if r.taken)


def test_repeated_rows_share_what_the_mix_takes(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s", k) for k in range(3)] + [(2, "x y", "t", 9), (2, "x z", "t", 8)], "doc_id long, text string, source string, __copy int")
    w = Workspace(spark, "t8r")
    rows = w.write(mixing.mix(docs, w), "mixed").collect()
    for _ in range(2):
        got = sorted((r.text, r["__copy"]) for r in mixing.mixed_texts(docs, w.write(mixing.mix(docs, w), "again"), w).collect())
        assert len(got) == sum(-(-r.taken // r.size) for r in rows)
        assert {k for _, k in got} == {0, 1, 2, 8, 9}


def test_targets_are_those_of_capping_over_and_over(spark):
    rng = random.Random(6)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{k}" if k else None: rng.choice([0, 1, 5, 40, 1000, 90_000]) for k in range(n)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("wide", [False, True])
def test_vectors_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    if wide:  # products of more columns than float32 adds up exactly, of any magnitude
        base = rng.normal(size=(12, 3000))
        rows = [(k, ((base[k % 12] + rng.normal(size=3000) * rng.uniform(0.13, 0.15)) * 10.0 ** rng.integers(-300, 300)).tolist(), k % 2) for k in range(150)]
    else:
        rows = []
        for k in range(500):
            x = rng.normal(size=24) if k % 3 == 0 else np.array(rows[rng.integers(k)][1]) + rng.normal(size=24) * rng.choice([0, 0.1, 0.2])
            rows.append((k, [float(y) for y in x.astype(np.float32)], int(k % 5 == 0)))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{'double' if wide else 'float'}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_dedup(df, Workspace(spark, "t9b")).collect()}
    assert got == brute.vectors(rows) and sum(n for n, _ in got.values()) > 100


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_dedup(df, Workspace(spark, "t9")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {k: (0, k, True) for k in range(4, 11)}
    assert embedding_dedup.near_dedup(df.limit(0), Workspace(spark, "t9e")).count() == 0


def test_components(spark, work):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), work, "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


def test_language(spark, docs):
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.fit(all_.where("not held_out"))
    out = language_id.identify(all_.where("held_out"), model, carry=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out)
    odd = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect() if r.doc_id in (2, 3, 7)}
    assert odd == {(2, "und"), (3, "und"), (7, "und")}
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}
    one = language_id.fit(docs)  # one language, repeated rows, and the sample's columns' names
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"und", "en"}
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ²", "①", "Ⅷ", "12 _", "é", "漢"])], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(marks, one).orderBy("doc_id").collect()] == ["und"] * 4 + ["en"] * 2


def test_gradients():
    rng = np.random.default_rng(2)
    net, w = language_id.ByteNet(3), rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.mask = net.mask.astype(np.float64)
    y, weight = rng.integers(0, 3, 5), rng.uniform(1, 2, 5)
    loss = lambda: -(np.log(net.probabilities(w)[np.arange(5), y]) * weight).sum() / weight.sum()
    g = net.gradients(w, y, weight)
    for name in ("filters", "out", "bias", "out_bias", "embed"):
        p = getattr(net, name)
        for at in np.argwhere(np.abs(g[name]) > 1e-4)[:6]:
            at, step = tuple(at), 1e-5
            p[at] += step
            up = loss()
            p[at] -= 2 * step
            down = loss()
            p[at] += step
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def posteriors_by_hand(rows):
    """(id, host, path, evidence) rows -> {id: score}: the same shrinkage in plain loops."""
    def groups(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[3])
        return out

    base = min(max(sum(r[3] for r in rows) / len(rows), 1e-4), 1 - 1e-4)

    def pseudo(found, around):
        over = sum((s - n * around(k)) ** 2 / n - around(k) * (1 - around(k)) for k, (n, s) in found.items())
        n, k = sum(n for n, _ in found.values()), len(found)
        between = max(over, 0) / max(n - k, 1)
        chance = sum(around(x) * (1 - around(x)) for x in found) / k
        return min(quality.MOST, max(quality.LEAST, chance / between if between > 0 else quality.MOST))

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: r[1:3])
    kh = pseudo(hosts, lambda _: base)
    rate = {h: (s + kh * base) / (n + kh) for h, (n, s) in hosts.items()}
    kp = pseudo(paths, lambda k: rate[k[0]])
    out = {}
    logit = lambda p: np.log(p / (1 - p))
    for i, h, q, p in rows:
        n, s = paths[h, q]
        own = min(max((s - p + kp * rate[h]) / (n - 1 + kp), 1e-4), 1 - 1e-4)
        out[i] = 1 / (1 + np.exp(-(logit(p) + logit(own) - logit(base))))
    return out


def test_quality(spark, docs):
    d = "/root/testdata/sf0.01"
    all_ = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", mixing.F.col("source").alias("host"), mixing.F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "cast(quality = 1 and toxic = 0 as int) as good")
    model = quality.fit(all_, labels.where("doc_id % 3 <> 0"))  # the others are held out
    got = quality.posteriors(all_, model, Workspace(spark, "t10q"))
    held = got.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(held) > 100 and sum(r.kept == (r.good == 1) for r in held) > 0.9 * len(held)
    rows = got.join(all_.select("doc_id", "host", "path"), "doc_id").collect()
    want = posteriors_by_hand([(r.doc_id, r.host, r.path, r.evidence) for r in rows])
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in rows)
    odd = docs.withColumnsRenamed({"source": "host", "lang": "path"})
    none = docs.selectExpr("doc_id", "1 as good").limit(0)
    assert quality.posteriors(odd, quality.fit(odd, none), Workspace(spark, "t10")).count() == len(ROWS)
    assert quality.posteriors(odd.limit(0), quality.fit(odd.limit(0), none), Workspace(spark, "t10e")).count() == 0


def test_sites(spark):
    pages = quality.sites(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "html as text", "1 as host"))
    model = quality.fit(pages, pages.selectExpr("page_id", "page_id % 2 as good"), key="page_id")
    got = quality.posteriors(pages, model, Workspace(spark, "t10s"), key="page_id").collect()  # many sparse hosts
    assert len(got) == pages.count() and all(0 <= r.score <= 1 and 0 < r.host_rate < 1 for r in got)
    urls = spark.createDataFrame([("http://www.A.com/x/y?z=1",), ("bad url",), (None,), ("https://b.org",)], "url string")
    assert [(r.host, r.path) for r in quality.sites(urls).collect()] == [("a.com", "/x"), (None, None), (None, None), ("b.org", None)]


def test_keys_are_integers_where_files_and_tiles_need_them(spark):
    odd = spark.createDataFrame([("a", "x", [1.0], 1)], "doc_id string, text string, embedding array<double>, label int")
    with pytest.raises(TypeError):
        token_files.write_files(odd, bpe.vocabulary("byte_bpe_50k.json"), Workspace(spark, "tk"))
    with pytest.raises(TypeError):
        embedding_dedup.near_dedup(odd, Workspace(spark, "tk"), key="doc_id")
    assert exact_dedup.dedup(odd, Workspace(spark, "tk")).first().keep_id == "a"


def test_filter_beyond_its_bound_lets_all_pass(spark, monkeypatch):
    rows = spark.range(100).select("id", mixing.F.col("id").alias("digest"))
    hits = rows.where("id < 3").select("digest")
    n = only_hits(rows, hits).count()
    monkeypatch.setattr(shared, "MOST_BITS", 1 << 10)
    assert 3 <= n < 50 and only_hits(rows, hits).count() == 100


def test_pipeline(spark):
    """Each stage against a plain version, on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, out = Workspace(spark, "tp"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = work.write(stage(spark, docs, SF), name)
        out.append(docs.collect())
    languages, cut, near, mixed, encoded = out
    first = spark.read.parquet(f"{SF}/documents.parquet").collect()
    letters = {r.doc_id for r in first if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in languages} <= letters and len(languages) > 0.9 * len(letters)
    want = brute.lines([(r.doc_id, r.text) for r in languages])
    assert {r.doc_id: r.text for r in cut} == {k: t for k, t in want.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in cut)
    groups = brute.jaccard([(r.doc_id, r.text) for r in cut])
    assert sorted(r.doc_id for r in near) == sorted(k for k, (_, c) in groups.items() if k == c)
    text, size = {r.doc_id: r.text for r in near}, {r.doc_id: len(brute.WORD.findall(r.text)) for r in near}
    assert all(r.text == text[r.doc_id] for r in mixed)
    sizes = {s: sum(size[r.doc_id] for r in near if r.source == s) for s in {r.source for r in near}}
    for s, goal in brute.targets(sizes).items():
        taken = sum(size[r.doc_id] for r in mixed if r.source == s)
        assert goal - 1 <= taken < goal + max(size[r.doc_id] for r in near if r.source == s)
    t = multi_encoding()
    assert sorted((r.doc_id, list(r.ids)) for r in encoded) == sorted((r.doc_id, t.encode_ordinary(r.text)) for r in mixed)
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == sorted((r.doc_id, r.n_tokens) for r in encoded)


@pytest.mark.parametrize("flush", [7, 2_000_000])
def test_counts_of_ngrams_are_exact(spark, monkeypatch, flush):
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    monkeypatch.setattr(jaccard_join, "RANGE", 50)
    monkeypatch.setattr(jaccard_join, "HEAVY_FROM", 3)
    rows = list(enumerate(["", None, "a b c d e f g " * 9, *["a b c d e f"] * 4, *varied(random.Random(8), 120)]))
    j = jaccard_join.Joiner(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Workspace(spark, "t4n"))
    j.classes()
    x, rank = j.heavy()
    count = Counter(int(h) >> 32 for _, t in rows for h in jaccard_join.shingles(t))
    want = [x for _, x in sorted((c, x) for x, c in count.items() if c >= 3)]
    assert x.tolist() == sorted(want) and [want[r - 1] for r in rank] == x.tolist() and len(want) > 20
