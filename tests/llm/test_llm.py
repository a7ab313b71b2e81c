import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from commitscope.llm import components, idcoder, kdtree, langid, license, merkle, mixing, nearcopies, pii, simhash, spm, tokenfile, urlfilter, wordbpe
from commitscope.llm.queries import PIECES, WORD_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else ("en" if i % 2 else "fr"), None if i % 5 == 0 else f"s{i % 3}", None, 0.0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


LONG = "The quick brown fox jumps over the lazy dog. " * 3000
TEXTS = [None, "", " \n", "Hello World again and again", "hello world again AND again", LONG, LONG, "été à la plage, où es-tu ?", "mail a.b@c.org +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.1", "12345", "x", "日本語 😀 text"]
OPS = [
    lambda d: pii.digest(pii.find(d)), simhash.near_duplicates, lambda d: tokenfile.summary(d, WORD_BPE), langid.identify, mixing.mix, license.scan, merkle.compare_with_next,
    lambda d: spm.encode(d, PIECES, "doc_id"), pii.redact,
]


@pytest.mark.parametrize("op", OPS)
def test_odd_rows_keep_their_number(spark, op):
    d = docs(spark, TEXTS)
    twice = d.union(d.limit(1)).union(spark.createDataFrame([(None, "no id", "en", "s1", 5, 1.0, "")], DOCS))
    assert op(twice).count() == len(TEXTS) + 2
    assert op(d.where("false")).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, ok in (("card", r"[0-9]([\x20-]?[0-9])+", lambda d: 16 <= len(d) <= 19 and luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 8 <= len(d) <= 15)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, t) if ok(re.sub("[^0-9]", "", m.group()))]
    return out


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["1", "4", "0", "255", "12", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_x", "é", "😀", "\n", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["1 " * 50000, "a" * 20000, 'token = "' + "0a" * 20 + '" x']
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "   "]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(1, 300))
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    fp = [np.uint64(simhash.fingerprint(t or "")) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(group))


def test_simhash_splits_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 20)
    rng = np.random.default_rng(5)
    mask = sum(1 << int(b) for b in (0, 1, 2, 9, 17, 30, 31, 32, 40, 50, 63))
    fps = sorted({int(x) & mask for x in rng.integers(0, 1 << 63, 400)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = components.connected_components(simhash.links(df)).collect()
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and want[i] != want[j]:
                a, b = want[i], want[j]
                want = [a if g == b else g for g in want]
    mine = {r["node"]: r["component"] for r in got}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    pairs = lambda g: {(i, j) for i in range(len(fps)) for j in range(i) if g[i] == g[j]}
    assert pairs([mine.get(s, s) for s in signed]) == pairs(want)


def test_components_of_a_long_path(spark):
    e = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (901, 900), (5, 5), (None, 3)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[901] == got[900] == 900


def test_kdtree_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(1)]) for i in range(400)] + [(400, None), (450, [float("nan")] * 8), (None, [1.0] * 8), (451, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = sorted(map(tuple, kdtree.top_k(df, F.expr("vec_id % 50 = 0"), 5, shard_rows=60, query_rows=3).collect()))
    v = {i: np.floor(np.array(x, np.float32).astype(float) * 256) for i, x in rows[:400]}
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == want
    assert kdtree.top_k(df.where("false"), F.expr("vec_id % 50 = 0")).count() == 0


def test_kdtree_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 0.0])] + [(7, [1.0, 1.0])] * 40 + [(8, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, kdtree.top_k(df, F.expr("vec_id % 50 = 0"), 3, shard_rows=8, query_rows=1).collect()))
    # the query's two vectors give 3 * 65536 and 2 * 65536 with vec_id 7; its own rows are no candidates
    assert got == [(0, r, 7, 3 * 65536) for r in (1, 2, 3)]


def test_id_coder_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, int), np.array([7]), rng.integers(0, 49408, 5000), np.zeros(3000, int), np.tile(rng.integers(0, 99, 700), 30)):
        block = idcoder.encode_block(ids, 49408)
        assert (idcoder.decode_block(block) == ids).all()
    assert len(block) < len(ids)  # repeats are predicted
    bad = bytearray(block)
    bad[-9] ^= 64
    with pytest.raises(idcoder.CorruptBlock):
        idcoder.decode_block(bytes(bad))


BITS = [
    "the", "The", "don't", "WE'RE", "'s", "x'll'd", "1a2", "42", "\u00e9", "\u00c9", "\u00c0\u00de\u00df", "\u00d7", "\u00f7", "a\u00d7b", "e\u0301", "\u212b", "<|", "<|endoftext|>", "a<|b", "<", "|", "||<",
    "\x00", "\x1c", "\x7f", "\u00a0", "\u2003", "\u00ff", "\u00c3", "\u00e3", "\u4e2d\u6587", "\U0001f600", "...", "&&&", "a.b", "\u0131", "\u0130", " ", " ", " ", "\t", "\n", "\x0b", "\u017f", "\ufb01", "\u0085",
]


def test_texts_cut_at_once_have_the_librarys_ids():
    words, rng = wordbpe.WordTokenizer(WORD_BPE), random.Random(3)
    for _ in range(1500):
        texts = ["".join(rng.choices(BITS, k=rng.randrange(12))) for _ in range(rng.randrange(6))]
        ids, n = words.encode(pa.array(["pad x", *texts, "end"]).slice(1, len(texts)), 2)
        want = [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_piece_is_encoded_once_whatever_words_it_stands_in():
    words = wordbpe.WordTokenizer(WORD_BPE)
    words.encode(pa.array([" ".join(f"{a}{n}{b}" for a in ("Alpha", "beta", "caf\u00e9") for n in range(1000) for b in ("", "...", "*"))]), 2)
    assert sorted(words.units) == sorted(["alpha", "beta", "caf\u00e9", "...", "*", *"0123456789"])


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    texts = [*TEXTS, "It's <|endoftext|> é ΑΣ naïve don't x1y2²", " a b\u0085c"]
    got = sorted(map(tuple, tokenfile.summary(docs(spark, texts), WORD_BPE).collect()))
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_langid_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [None, "", "123 !?", "  "])).collect()} == {"und"}


def test_apportionment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 7)
        w, cap, seats = rng.integers(0, 20, n), rng.integers(0, 9, n), int(rng.integers(0, 30))
        got = np.zeros(n, int)
        for _ in range(seats):
            q = [(-w[i] / (2 * got[i] + 1), i) for i in range(n) if w[i] > 0 and got[i] < cap[i]]
            if q:
                got[min(q)[1]] += 1
        assert (mixing.apportion(seats, w, cap) == got).all()
    assert mixing.targets([10, 100], [3, 1]) == pytest.approx([30, 80])


def test_mix_meets_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(d).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.02 * rs[0]["target"]


def test_license_rules():
    rules = license.Rules()
    found = lambda t: [m[0] for m in rules.match(rules.sentences(t))]
    assert found("Some text.\nLicensed under the   Apache License, Version 2.0.\nMore") == ["Apache-2.0"]
    s = license.SENTENCES
    bsd = "\n".join(s[k] + "." for k in ("bsd-conditions", "bsd-source", "bsd-binary"))
    assert found(bsd) == ["BSD-2-Clause"] and found(bsd + "\n" + s["bsd-endorse"]) == ["BSD-3-Clause"]
    assert found("\n".join(s[k] for k in ("bsd-source", "bsd-conditions"))) == [] and found("licensed to nobody") == []
    far = s["bsd-conditions"] + ". a. b. c. d. " + s["bsd-source"] + ". " + s["bsd-binary"]
    assert found(far) == [] and found((s["mit-title"] + ".\n") * 30_000 + bsd) == ["BSD-2-Clause"]


def test_url_filter(spark):
    rows = [
        (1, "http://a.example.org/es/x", '<link rel="canonical" href="http://q.net/z">'), (2, "http://q.net/z?utm_source=f#x", None), (3, "http://q.net/other?a=1", "<META content='0; url=/z' http-equiv=refresh>"),
        (4, None, None), (5, "nourl", "x"), (6, "HTTP://B.Com/de/", "<link href='//r.net/w' rel=canonical>"), (7, "http://r.net/w", '<link rel=canonical href="http://x.com/fr/a">'), (8, "http://zcom/de/", ""), (9, "http://c.org", ""),
        (10, "http://example.org/en/12", ""), (11, "http://example.org/en/2", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(0))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][3] == "block" and got[3][3] == "block"
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("b.com", "/de/", "com/de/", "block") and got[7][3] == "allow"  # an allowed alias comes first
    assert got[8][2] is None and got[9][1:3] == ("", None) and got[10][2:] == ("example.org/en/1", "block") and got[11][2:] == ("org/", "allow")
    assert urlfilter.judge(df.where("false")).count() == 0


def _leaves_by_hand(text):
    """Leaves of a text, cut one character at a time."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        now = ""
        for c in line:
            now += c
            if len(now) == merkle.MOST or (len(now) >= merkle.LEAST and 32 <= ord(c) < 0xD800 and (ord(c) * 668265263 & 0xFFFFFFFF) >> 29 == 0):
                out.append(now)
                now = ""
        out += [now] if now else []
    return out


def _alike_by_hand(a, b):
    if a == b:
        return 1.0
    x, y = _leaves_by_hand(a), _leaves_by_hand(b)
    rest, shared = list(y), 0
    for leaf in x:
        if leaf in rest:
            rest.remove(leaf)
            shared += 1
    return min(2 * shared / (len(x) + len(y)), 1 - 1 / (len(x) + len(y) + 1)) if x and y else 0.0


def _check_edits(a, b, runs):
    """Outside of the runs both texts are equal; there are none for equal texts and some for unequal ones."""
    p = q = 0
    for s, e, t, f in runs:
        assert a[p:s] == b[q:t]
        p, q = e, f
    assert a[p:] == b[q:] and bool(runs) == (a != b)


def test_merkle(spark):
    rng = random.Random(2)
    dense = ["".join(rng.choice(letters) for _ in range(1500)) for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "日本語文章東京都大阪市のがをには", "0123456789")]
    texts = ["para one is here\npara two, somewhat longer than the first one is\n\nlast", "", "a", None, "same", "same", LONG[:9000], *dense, *(t[:700] + t[:700] for t in dense), "😀" * 300]
    got = {r["doc_id"]: r for r in merkle.compare_with_next(docs(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == merkle.fingerprint(t) and r["edited_fingerprint"] == merkle.fingerprint(e)
        assert r["near_edited"] == pytest.approx(_alike_by_hand(t, e)) and r["near_next"] == pytest.approx(_alike_by_hand(t, n))
        _check_edits(t, e, [tuple(map(int, re.split("[:>]", x))) for x in r["edits"].split(",") if x])
    assert got[5]["near_next"] == 1.0
    for i in (7, 8, 9):  # half-equal texts without a blank
        assert 0.3 < got[i]["near_edited"] < 0.7


def test_merkle_differences():
    rng = random.Random(3)
    for _ in range(800):
        x = "".join(rng.choice(["a ", "bc\n", "f", "\n\n", "Q9", "zz " * 9, "é", "once upon a time "]) for _ in range(rng.randint(0, 60)))
        y = x
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randint(0, len(y)), rng.choice("ids")
            y = y[:i] + "new text here\n"[: rng.randint(1, 14)] + y[i:] if kind == "i" else y[:i] + y[i + rng.randint(1, 30) :] if kind == "d" else y[i:] + y[:i]
        a, b = merkle.fingerprint(x), merkle.fingerprint(y)
        assert (a == b) == (x == y) == (merkle.likeness(a, b) == 1.0) and merkle.parsed(a) == (a[: merkle.NODE_HEX], merkle.tree(x))
        _check_edits(x, y, merkle.edits(x, y, merkle.parsed(a), merkle.parsed(b)))
    one, two = "first paragraph of a text\n", "the second one, quite another\n"
    swapped = merkle.fingerprint(one + two), merkle.fingerprint(two + one)
    assert merkle.differences(*swapped) and 0.5 < merkle.likeness(*swapped) < 1
    assert merkle.differences(merkle.fingerprint(one + two), merkle.fingerprint(one)) == [(2, 4, 2, 2)]  # the second paragraph has two leaves
    assert merkle.places(merkle.fingerprint(one + two))[-1] in ((0, 1), (1, 0))
    # one changed word in a long text is one short run
    changed = merkle.edits(LONG, LONG[:70_000] + "X" + LONG[70_001:], *(merkle.parsed(merkle.fingerprint(t)) for t in (LONG, LONG[:70_000] + "X" + LONG[70_001:])))
    assert len(changed) == 1 and changed[0][0] <= 70_000 < changed[0][1] <= changed[0][0] + 4 * merkle.MOST


def test_merkle_order_over_many_ranges(spark):
    ids = random.Random(5).sample(range(-500, 5000), 400)
    d = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(40)
    got = {r["doc_id"]: r["edited_sha256"] for r in merkle.compare_with_next(d).collect()}
    order = sorted(ids, reverse=True)
    for i, k in enumerate(order):
        e = merkle.edited(f"text of {k}", f"text of {order[(i + 1) % len(order)]}")
        assert got[k] == hashlib.sha256(e.encode()).hexdigest()
    assert merkle.compare_with_next(d.where(f"doc_id = {ids[0]}")).first()["near_next"] == 1.0


def test_sentencepiece_equals_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        model = spm.Model(f.read())
    rng = random.Random(1)
    letters = "abcde  théñ日本語\n\t.,!?0123Ελλ😀'\"-_/АБв "
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(kind) for _ in range(rng.randint(40, 3000))) for kind in (base64, "01", "日本語文章東京都", letters.replace(" ", ""), "=-_*", "aé", "a") for _ in range(6)]
    ids, n = model.encode_batch(texts)
    cut = np.split(ids, np.cumsum(n)[:-1])
    assert [c.tolist() for c in cut] == lib.encode(texts)
    assert [x.decode() for x in model.decode_batch(ids, n)] == texts


def _message(fields):
    out = b""
    for no, v in fields:
        raw = v if isinstance(v, bytes) else None
        out += bytes([no << 3 | 2, len(raw)]) + raw if raw is not None else bytes([no << 3 & 127 | (128 if no > 15 else 0)] + ([no >> 4] if no > 15 else []) + [v])
    return out


def test_sentencepiece_refuses_other_models():
    piece = _message([(1, b"a")])
    plain = {3: 2}, {3: 1, 4: 0}
    for train, normal in (({3: 1}, plain[1]), ({}, plain[1]), ({3: 2, 24: 1}, plain[1]), (plain[0], {4: 0, 2: b"map"}), (plain[0], {4: 1}), (plain[0], {}), (plain[0], {4: 0, 5: 0})):
        with pytest.raises(ValueError, match="unsupported"):
            spm.Model(_message([(1, piece), (2, _message(train.items())), (3, _message(normal.items()))]))
    spm.Model(_message([(1, piece), (2, _message(plain[0].items())), (3, _message(plain[1].items()))]))


def test_other_tokenizers_go_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Hello  World\n", None, "", "é 1 x"]
    got = sorted(map(tuple, tokenfile.summary(docs(spark, texts), path, end_id=7).collect()))
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 7]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def _link_graph(rng, n):
    """Pages with chains, cycles and stars of canonical links and refreshes, and each page's target by hand."""
    hosts = ["a.example.org", "q.net", "b.com", "x.com", "zcom"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/es/', '/en/', '/fr/', '/de/', '/'])}{i}" for i in range(n)]
    rows, edges = [], []
    for i, u in enumerate(urls):
        target, html = None, "<p>nothing</p>"
        if rng.random() < 0.5:
            target = urls[min(rng.randrange(n), rng.randrange(n))] if rng.random() < 0.9 else f"http://{rng.choice(hosts)}/de/gone{rng.randrange(5)}"
            html = rng.choice([f'<link rel="canonical" href="{target}">', f"<link href='{target}?utm_source=z' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={target}#top">'])
            edges.append((u, target))
        rows.append((i, u, html))
    return rows, edges


def test_url_filter_equals_brute_force_components(spark):
    rng = random.Random(12)
    rows, edges = _link_graph(rng, 400)
    rows += [rows[3], (None, rows[5][1], rows[5][2])]

    def own(url):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [(len(h) + len(p), v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    group = {u: u for e in edges for u in e} | {r[1]: r[1] for r in rows}
    for a, b in edges:
        x, y = group[a], group[b]
        if x != y:
            group = {u: x if g == y else g for u, g in group.items()}
    says = {}
    for u, g in group.items():
        says.setdefault(g, set()).add(own(u)[0])
    want = sorted((r[0] is None, r[0] or 0, own(r[1])[1], own(r[1])[0] or ("allow" if "allow" in says[group[r[1]]] else "block" if "block" in says[group[r[1]]] else "allow")) for r in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = urlfilter.judge(df).collect()
    assert sorted(((r["page_id"] is None, r["page_id"] or 0, r["rule"], r["verdict"]) for r in got), key=str) == sorted(want, key=str)
    by_alias = [r for r in got if r["decided_by"] == "alias"]
    assert {r["verdict"] for r in by_alias} == {"allow", "block"}
    # of rules of one length the first counts
    tie = [("block", "q.net", "/a"), ("allow", "q.net", "/a"), ("allow", ".net", "/ab")]
    one = spark.createDataFrame([(1, "http://q.net/abc", None)], "page_id long, url string, html string")
    assert urlfilter.judge(one, tie).first()["verdict"] == "block"
    assert urlfilter.judge(one, tie[1::-1]).first()["verdict"] == "allow"


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = d.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, sf).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name in ("language_id", "personal_data"):
            assert d.columns == corpus_pipeline.COLUMNS and d.count() == n
        if name == "near_duplicates":
            assert 0 < d.count() <= n and d.select("doc_id").distinct().count() == d.count()
        n = d.count()
    assert d.where("not exact").count() == 0 and n > 0


def _groups(texts):
    """Group of each text by brute force over 5-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("all_pairs", [16, 2])
def test_near_duplicates_stage_equals_brute_force(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(nearcopies, "ALL_PAIRS", all_pairs)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(80, 300))
        for edits in (0, 1, 1, 2, 9, 25):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    group = _groups(texts)
    d = docs(spark, texts)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect())
    assert got == sorted(set(group)) and len(got) < 100
    extra = spark.createDataFrame([(None, texts[10], "en", "s1", 1, 0.0, ""), (None, "no id and no copy", "en", "s1", 1, 0.0, ""), (10, "other text of ten", "en", "s1", 1, 0.0, "")], DOCS)
    more = corpus_pipeline.near_duplicates(spark, d.union(extra).union(d.limit(5)), "").collect()
    assert sorted(r["text"] for r in more if r["doc_id"] is None or r["text"] == "other text of ten") == ["no id and no copy", "other text of ten"]
    assert len(more) == len(got) + 2


def _template(rng, n, share, words=100):
    """Pages of one template with words of their own, so that any two share ``share`` of their shingles or so."""
    base = [f"t{i}" for i in range(words)]
    own = round((1 - share) / (1 + share) * (words - 4) / 5)
    pages = []
    for p in range(n):
        t = list(base)
        for k in range(own):
            t[2 + 5 * (k + 1) + 5 * ((words // 5 - own) // 2)] = f"p{p}w{k}"
        pages.append(t)
    return pages


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_in_dense_clouds_equal_brute_force(spark, monkeypatch, small_blocks):
    """Templated pages just below the threshold, all of them candidates of each other, with planted pairs just above it."""
    if small_blocks:
        monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 37)
    rng = random.Random(3)
    texts = []
    for share, n in ((0.75, 120), (0.78, 240), (0.82, 60)):
        pages = _template(rng, n, share, 130 if share < 0.8 else 90)
        near = [list(p) for p in pages[:30]]
        for t in near:
            t[0] = f"x{rng.random()}"  # at the very edge one shingle differs
        texts += [f"{'' if share < 0.8 else 'c '}" + " ".join(p) for p in pages + near]
    texts += ["", " ", " \n", "one", "ONE", "two"] + ["w " * 40 + f"end{i}" for i in range(40)]
    group = _groups(texts)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").collect())
    assert got == sorted(set(group))
    assert len(texts) - len(got) > 100


def test_forest_joins_all_that_alike_sets_join():
    rng = np.random.default_rng(4)
    sets = []
    for g in range(12):
        base = rng.choice(10**6, 60, replace=False).astype(np.uint64)
        for _ in range(8):
            t = base.copy()
            t[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.choice(10**6, 1).astype(np.uint64)
            sets.append(np.unique(t))
    sets += [np.empty(0, np.uint64)] * 3
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    for first in (None, 40):
        comp = np.arange(len(sets))
        comp[:20] = comp[0]
        want, got = comp.copy(), comp.copy()
        pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if (i < j if first is None else i < first <= j)]
        for i, j in pairs:
            if nearcopies.alike(sets[i], sets[j]):
                want[want == want[j]] = want[i]
        for i, j in nearcopies.forest(sets, comp, first):
            assert nearcopies.alike(sets[i], sets[j])
            got[got == got[j]] = got[i]
        assert all((want[i] == want[j]) == (got[i] == got[j]) for i in range(len(sets)) for j in range(i))


def _lengths(spark):
    """Three sources of uneven size; most words stand in documents far longer than a block."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        n = rng.choice((20, 90, 700, 2500))
        rows.append((i, f"d{i} " + "w " * (n - 1), "en", ("hot", "hot", "hot", "hot", "mid", "small")[i % 6], n, 0.0, ""))
    return spark.createDataFrame(rows, DOCS)


def test_source_mix_stage_meets_targets_at_every_length(spark):
    d = _lengths(spark)
    want = {r["source"]: r["target"] for r in mixing.mix(d).select("source", "target").distinct().collect()}
    share = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(d).select("source", "source_size", "target").distinct().collect()}
    got, longest, had = {}, {}, {}
    for r in corpus_pipeline.source_mix(spark, d, "").collect():
        got[r["source"]] = got.get(r["source"], 0) + r["n_chars"]
        longest[r["source"]] = longest.get(r["source"], 0) + (r["n_chars"] == 2500)
    for r in d.collect():
        had[r["source"]] = had.get(r["source"], 0) + (r["n_chars"] == 2500)
    assert min(share.values()) < 0.5  # where rounding would leave no long document
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=0.01) and longest[s] / had[s] == pytest.approx(share[s], rel=0.15), s


def test_source_mix_stage_with_null_and_repeated_ids(spark):
    texts = [f"t{i} " + "w " * 39 for i in range(600)]
    rows = [(None if i % 3 == 0 else i // 50, t, "en", None if i % 4 == 0 else f"s{i % 2}", 40, 0.0, "") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows + [rows[7]] * 3 + [rows[9]] * 2, DOCS)
    want = {}
    for r in mixing.copies(d).join(d.select(F.xxhash64("text").alias("body"), "text").distinct(), "body").collect():
        want[r["text"], r["doc_id"]] = want.get((r["text"], r["doc_id"]), 0) + r["times"]
    got, by = {}, {}
    for r in corpus_pipeline.source_mix(spark, d, "").collect():
        got[r["text"], r["doc_id"]] = got.get((r["text"], r["doc_id"]), 0) + 1
        by[r["source"]] = by.get(r["source"], 0) + 40
    assert got == {k: n for k, n in want.items() if n}
    equal = {rows[7][1]: 4, rows[9][1]: 3}
    assert all(n <= 3 * equal.get(t, 1) for (t, _), n in got.items()) and sum(n for (_, i), n in got.items() if i is None) > 100
    for r in mixing.mix(d).select("source", "target").distinct().collect():
        assert by[r["source"]] == pytest.approx(r["target"], rel=0.01, abs=40)


def test_license_wrapped_and_commented(spark):
    import textwrap

    s = license.SENTENCES
    mit = ["MIT License", "Copyright (c) 2020 A. Body", s["mit-grant"], s["mit-keep"] + "."]
    bsd = [s["bsd-conditions"], "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + "."]
    gpl = [s["gpl-redistribute"] + ".", s["gpl-hope"] + "; without even the implied warranty of FITNESS."]
    lgpl, isc = [s["lgpl-21-redistribute"] + "."], [s["isc-grant"] + "."]
    apache = ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", s["apache-terms"], "1. Definitions."]
    texts, want = [], []
    for mark in ("", "# ", "// ", " * ", ";; ", "! ", "dnl ", "REM "):
        for eol in ("\n", "\r\n"):
            for paras, spdx in ((mit, "MIT"), (bsd, "BSD-2-Clause"), (gpl, "GPL-3.0-or-later"), (lgpl, "LGPL-2.1-or-later"), (isc, "ISC"), (apache, "Apache-2.0")):
                lines = [w for p in paras for one in p.split("\n") for w in [*textwrap.wrap(one, 60)]] if paras is bsd else "\n\n".join("\n".join(textwrap.wrap(one, 60)) if "\n" not in p else one for p in paras for one in [p]).split("\n")
                texts.append("/* x\n\n" + eol.join((mark + x).rstrip() for x in lines) + eol + "end")
                want.append(spdx)
    got = {r["doc_id"]: r for r in license.scan(docs(spark, texts)).collect()}
    for i, w in enumerate(want):
        assert got[i]["licenses"] == w and got[i]["n_matches"] == 1, texts[i]
        _, a, b = got[i]["spans"].rsplit(":", 2)
        words = license.normalise(texts[i][int(a) : int(b)])
        assert words.split()[-1] in "substantial software distribution warranty version copies".split() and a != b
    rules = license.Rules()
    found = lambda t: [m[0] for m in rules.match(rules.sentences(t))]
    assert found("# Licensed under the MIT License\n# by A\nimport x") == ["MIT"]
    half = s["isc-grant"].split(" and ", 1)
    assert found(half[0] + "\n\nand " + half[1]) == [] and found(half[0] + ".\nand " + half[1]) == []
    assert [m[0] for m in license.tagged("// SPDX-License-Identifier: (MIT OR Apache-2.0)\n# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */")] == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0"]


def test_url_filter_long_tags_and_quoted_ends(spark):
    far = "http://q.net/" + "z" * 20_000
    rows = [
        (1, far, None), (2, "http://q.net/a", f'<link rel="canonical" data-x="{"y" * 9000}" href="{far}">'), (3, "http://example.org/es/x", f"<link rel=canonical href='{far}'>"),
        (4, "http://q.net/b", '<link title="a > b" rel="canonical" href="http://example.org/es/y">'), (5, "http://q.net/c", "<meta data-t='>' http-equiv=refresh content='0; url=http://example.org/es/z'>"),
        (6, "http://q.net/d", 'x <link title="open> <link rel=canonical href=http://example.org/es/w>'), (7, "http://q.net/e", "<link " + "a=b " * 50_000 + " rel=canonical href=http://example.org/es/v>"),
    ]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(1, 8)}


def _added_by_hand(t, weights):
    """Accepted spans beyond the base ones, by plain regular expressions and votes written out one by one."""
    import regex

    out = []
    base = base_spans(t)
    word = lambda c: bool(c) and c.isalnum()

    def offer(kind, s, e, v, pattern, shape, gazetteer, joined):
        before = t[max(0, s - pii.BEFORE) : s]
        context = 2 if re.search(pii.CONTEXT[kind], before) else 0 if re.search(pii.AGAINST[kind], before) else 1
        votes = [pattern, shape, gazetteer, context, 0 if joined else 2]
        many, letters, figures = len(set(v)), bool(re.search("[A-Za-z]", v)), bool(re.search("[0-9]", v))
        bins = (sum(len(v) >= n for n in pii.LENGTHS) * 3 + sum(many >= n for n in pii.VARIETY)) * 3 + (2 if letters and figures else 1 if letters else 0)
        if pii.log_odds(weights, pii.KINDS.index(kind), sum(d * 3**i for i, d in enumerate(votes)), bins) >= 0 and not any(s < b and a < e for _k, a, b in base):
            out.append((kind, s, e))

    edges = lambda m: word(t[m.start() - 1 : m.start()]) or word(t[m.end() : m.end() + 1])
    for m in regex.finditer(pii.SPELLED, t):
        v = m.group()
        offer("email", *m.span(), v, 1, 2 if re.search(r"(?i)[.)\]] ?[a-z]{2,24}$", v) else 0, 2 if re.search(pii.DOMAINS, v) else 1, edges(m))
    for m in regex.finditer(pii.IP, t):
        if not regex.search(pii.OCTETS, m.group()):
            offer("ip", *m.span(), m.group(), 0, 0 if re.search(r"(?:^|\.)0[0-9]", m.group()) else 2, 2 if re.search(r"^(?!0|127\.|255\.)", m.group()) else 0, edges(m))
    for m in regex.finditer(pii.CHAIN, t):
        v, d = m.group(), re.sub("[^0-9]", "", m.group())
        if not (16 <= len(d) <= 19 and luhn(d)):
            offer("card", *m.span(), v, 1 if luhn(d) else 0, 2 if len(d) in (15, 16) and not ("-" in v and " " in v) else 0, 2 if re.search(pii.ISSUERS, d) else 0, edges(m))
    for m in regex.finditer(pii.PHONE, t):
        d = re.sub("[^0-9]", "", m.group())
        if not 8 <= len(d) <= 15:
            offer("phone", *m.span(), m.group(), 0, 0, 2 if re.search(pii.CALLING, m.group()) else 1, edges(m))
    for m in regex.finditer(pii.NATIONAL, t):
        offer("phone", *m.span(), m.group(), 1, 2, 2 if re.search(pii.CALLING, m.group()) else 1, edges(m))
    for m in regex.finditer(pii.SECRET, t):
        v = regex.search(pii.VALUE, m.group()).group(1)
        e = m.end() - (m.group()[-1] in "\"'")
        offer("secret", e - len(v), e, v, 2 if regex.search(pii.KNOWN, v) else 1, 2 if re.search("[A-Za-z]", v) and re.search("[0-9]", v) else 0, 0 if re.search(pii.PLACEHOLDER, v) else 2, word(t[m.end() : m.end() + 1]))
    return sorted(out, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


PII_TEXTS = [
    "write to jo.doe [at] mail [dot] example.org or jo(at)site.net.", "call (212) 555-0142 or 212-555-0142", "order no. 212-555-0142", "part 555-123.4567", "ip 300.1.2.3 and 1.2.3.400",
    "378282246310005 amex", "4111 1111 1111 1112 not", "visa 4222222222222", 'token = "' + "0af3" * 10 + '"', "secret: " + "9Zx_" * 50, 'password = "changeme-changeme-1"', "api_key: your_api_key_goes_here", '"api_key": "Ab3dEf6hIj9kLm2n"',
    "+12 3", "+1234567890123456789", "passwd='aaaaaaaaaaaaaaaaaaaa'", "token =\n\n\n   'q1w2e3r4t5y6u7i8o9p0'", "x" * 300 + "@", "\U0001f600 token = \"" + "7c" * 16 + "\"é",
]


def test_pii_numbers_of_invoices_are_no_phones(spark):
    texts = ["invoice no. 012-555-0132", "order #212-555-0142", "call 212-555-0142", "isbn 4111 1111 1111 1111 1", "tel 012-555-0132"]
    got = {r["doc_id"]: [pii.KINDS[x["kind"]] for x in r["spans"]] for r in pii.find(docs(spark, texts)).collect()}
    assert [got[i] for i in (0, 1, 2, 4)] == [[], [], ["phone"], ["phone"]]


def test_release_leaves_other_threads_tables(spark):
    import threading

    from commitscope.llm import common

    mine = common.written(spark.range(3), "mine")
    other = threading.Thread(target=lambda: (common.written(spark.range(2), "other"), common.release(spark)))
    other.start()
    other.join()
    assert mine.count() == 3
    common.release(spark, common.noted() - 1)


def test_pii_added_spans_equal_brute_force(spark):
    rng = random.Random(9)
    texts = PII_TEXTS + [" ".join(rng.sample(PII_TEXTS, 3)) for _ in range(60)]
    d = docs(spark, texts)
    weights = pii.learn(d.select(pii.candidate_spans(F.coalesce("text", F.lit(""))).alias("spans")))
    got = {r["doc_id"]: [(pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["spans"] if not x["base"]] for r in pii.find(d).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _added_by_hand(t, weights), t
    kinds = {k for spans in got.values() for k, _s, _e in spans}
    assert kinds == {"email", "phone", "card", "secret"} and got[10] == [] and got[11] == [] and got[6] == []
    value = got[9][0]
    assert texts[9][value[1] : value[2]] == "9Zx_" * 50  # the value alone, of any length


def test_pii_spans_do_not_depend_on_the_table(spark):
    lines = lambda d: {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(d)).collect()}
    own = docs(spark, PII_TEXTS).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    alone = lines(own)
    for i in (0, 8, 9, 12):
        assert lines(own.where(F.col("doc_id") == -1 - i)) == {-1 - i: alone[-1 - i]}
    for sf in ("0.001", "0.01", "0.1"):
        d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
        found = lines(d.union(own))
        assert {k: found[k] for k in alone} == alone
        left = pii.redact(d).where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count()
        assert left == 0


#: Licence texts that systems keep, and what they and their appendices name.
TEXT_FILES = {
    "Apache-2.0": {"Apache-2.0"}, "Artistic": {"Artistic-1.0"}, "BSD": {"BSD-3-Clause"}, "CC0-1.0": {"CC0-1.0"}, "GFDL-1.3": {"GFDL-1.3-only"}, "GPL-2": {"GPL-2.0-only", "GPL-2.0-or-later"}, "GPL-3": {"GPL-3.0-only", "GPL-3.0-or-later"},
    "LGPL-2.1": {"LGPL-2.1-only", "LGPL-2.1-or-later"}, "LGPL-3": {"LGPL-3.0-only"}, "MPL-1.1": {"MPL-1.1"}, "MPL-2.0": {"MPL-2.0"},
}


@pytest.mark.parametrize("name", TEXT_FILES)
def test_license_whole_texts(name):
    import os
    import textwrap

    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no licence texts here")
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    rules = license.Rules()
    for width in (60, 72, 80):
        paras = ["\n".join(textwrap.wrap(p, width)) for p in re.split(r"\n\s*\n", text)]
        lines = "\n\n".join(paras).split("\n")
        for mark in ("", " " * 41, "# ", "// ", " * ", "#" * 45 + " "):
            assert {m[0] for m in rules.match(rules.sentences("\n".join(mark + x for x in lines)))} == TEXT_FILES[name], (width, mark)


def test_license_notices_equal_brute_force():
    import textwrap

    rules, rng = license.Rules(), random.Random(4)
    one = {}
    for spdx, sentences in reversed(license.generated() + [(k, [license.SENTENCES[x] for x in v]) for k, v in license.RULES]):
        if len(sentences) == 1 and len(license.SENTENCE.findall(sentences[0])) == 1:
            one[license.normalise(sentences[0])] = spdx
    first = {license.normalise(license.SENTENCES[v[0]]): k for k, v in license.RULES if len(v) == 1}
    known = sorted(one)
    assert len(known) > 2000
    for _ in range(150):
        paras = [rng.choice(known) if rng.random() < 0.6 else "some plain words, not " + " ".join(reversed(rng.choice(known).split())) for _ in range(8)]
        want = [first.get(p, one[p]) for p in paras if p in one]
        width, mark = rng.choice((30, 72, 1000)), rng.choice(("", "# ", "* ", "    "))
        text = "\n\n".join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in paras)
        assert [m[0] for m in rules.match(rules.sentences(text))] == want


def test_pipeline_leaves_no_shuffle_files(spark):
    held = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(key, None)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    until = time.time() + 20  # they are removed in the background
    while (left := held() - before) and time.time() < until:
        time.sleep(0.5)
    assert not left and spark.conf.get(key, None) == setting
