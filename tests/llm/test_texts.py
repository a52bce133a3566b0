"""Text operators against brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from sigloom.llm import bpe, langid, lmscore, packing, pii, simhash, substrings
from sigloom.llm.components import connected_components
from sigloom.llm.work import Workspace

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def corpus(n, seed, copies=True):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(rnd.choices(words, k=30)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = rnd.choices(words, k=rnd.randint(0, 80))
        if copies and rnd.random() < 0.5:
            t.insert(rnd.randint(0, len(t)), rnd.choice(shared))
        out.append(rnd.choice([" ", "\n", "  "]).join(t))
    return out + ([out[3], out[3], "x " * 60] if copies else [])


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_masks_cover_every_radius():
    rnd = random.Random(4)
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 15
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(not d & m for m in masks)


def test_fingerprint_by_definition():
    for text in ("", "one", "One TWO", "a b c d e", "É é A a b"):
        w = text.encode().split()
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("bucket", [512, 8])
def test_links_are_exact_at_any_bucket_size(spark, bucket):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 30, np.int64)
    fps = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(12):
            fps.add(int(b) ^ int(sum(1 << int(i) for i in rng.choice(60, rng.integers(1, 4), False))))
    fps = sorted(fps)
    ws = Workspace(spark, "test")
    got = simhash.links(ws, spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket).collect()
    a, b = {f: f for f in fps}, {f: f for f in fps}
    for r in got:
        assert (r.a ^ r.b).bit_count() <= 3
        a[max(find(a, r.a), find(a, r.b))] = min(find(a, r.a), find(a, r.b))
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                b[max(find(b, x), find(b, y))] = min(find(b, x), find(b, y))
    assert [find(a, f) for f in fps] == [find(b, f) for f in fps]


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(Workspace(spark, "test"), spark.createDataFrame(pairs + [(None, 3), (5, 5)], "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}
    for x, y in pairs:
        parent[max(find(parent, x), find(parent, y))] = min(find(parent, x), find(parent, y))
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(parent, x) for x in linked}


def plain_removal(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    texts = corpus(60, seed)
    got = sorted(substrings.remove_repeats(documents(spark, texts)).collect())
    want = plain_removal(texts)
    assert sum(w[1] for w in want) > 100
    for r, (n, gone, kept), t in zip(got, want, texts):
        assert (r.n_words, r.n_removed) == (n, gone)
        assert (" ".join(t.split()) if r.kept is None else r.kept) == kept


def test_no_candidates_end_the_ladder(spark):
    assert sum(r.n_removed for r in substrings.remove_repeats(documents(spark, corpus(20, 5, False))).collect()) == 0


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "phone": 10 <= len(d) <= 15}[kind]


def test_base_spans_against_plain_patterns(spark):
    rnd = random.Random(7)
    bits = ["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "999.1.1.1", "a.b@c.de", "@x.y", "+1 (415) 555-0100", "+12", " ", "-", ".", "5", "é", "\U0001f600", "a@b", "7 ", "0-0", "_"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(400)] + ["a@b.c_d@e.f 1.2.3.4.5.6.7.8", "1 2 " * 700, "x@y.z" * 1200]
    got = sorted(pii.find(documents(spark, texts)).collect())
    for r, t in zip(got, texts):
        assert [tuple(s) for s in r.base] == sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, t) if valid(kind, m.group())), t


def test_contexts_discover_and_redact(spark):
    texts = [f"please phone him on +1 415 555 {1000 + i} today {i}" for i in range(12)] + ["please phone him on 4155551234 now", "chapter 19990101 begins"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [tuple(s) for s in got[12].spans] == [(20, 3, 30)] and got[12].base == [] and got[13].spans == []
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[0] == "please phone him on [PHONE] today 0" and out[12] == "please phone him on [PHONE] now" and out[13] == texts[13]


def test_planted_identifiers_are_found_and_numbers_alike_are_not(spark):
    """Typed cards with a wrong digit, phones without a plus and mail with odd ends, in contexts of seeds; orders and dates in contexts of their own."""
    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def luhn(head):
        return next(head + str(c) for c in range(10) if sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, head + str(c)))) % 10 == 0)

    filler = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "kappa", "sigma"]) for _ in range(rnd.randint(3, 9)))
    texts, planted, clean = [], {}, set()
    for i in range(600):
        kind = i % 6
        said = {
            0: f"pay by card number: {luhn('4' + digits(14))} before friday",
            1: f"call me on +1 ({digits(3)}) 555-{digits(4)} after work",
            2: f"your order 9{digits(15)} was shipped",
            3: f"on the day 20{digits(6)} it rained",
            4: f"pay by card number: {luhn('5' + digits(14))} before friday",
            5: f"call me on +44 20 {digits(4)} {digits(4)} after work",
        }[kind]
        if i % 30 == 12:
            bad = luhn("4" + digits(14))
            hit = bad[:-1] + str((int(bad[-1]) + 1) % 10)
            said, planted[i] = f"pay by card number: {hit} before friday", (2, hit)
        elif i % 30 == 1:
            hit = f"020 {digits(4)} {digits(4)}"
            said, planted[i] = f"call me on {hit} after work", (3, hit)
        elif kind in (2, 3):
            clean.add(i)
        texts.append(f"{filler()} {said} {filler()}")
    got = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    found = {i for i, (k, hit) in planted.items() if any(s.rank == k and texts[i][s.start : s.end] == hit for s in got[i].spans)}
    assert len(found) / len(planted) >= 0.95
    assert sum(len(got[i].spans) > len(got[i].base) for i in clean) / len(clean) <= 0.01


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    text = " ".join(f"{i % 200}.1.2.3 w{i}" for i in range(20000)) + " +1 (415) 555-1234"
    row = pii.find(documents(spark, [text])).collect()[0]
    want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text)]
    assert [(s.start, s.end) for s in row.base if s.rank == 1] == want
    out = pii.redact(documents(spark, [text])).collect()[0].text
    assert out == re.sub(r"\b[0-9]+(\.[0-9]+){3}\b", "[IP]", text).replace("+1 (415) 555-1234", "[PHONE]")


def test_encoders_agree_with_the_library():
    a, b = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    texts = corpus(20, 9) + ["", "  two  spaces \n\n lines\t", "it's I'LL", "<|endoftext|> x <|startoftext|>", "naïve café ́ 日本語テキスト" * 60, "x" * 4000, "a b c İΣ"]
    enc, coder = packing.encoder(BYTES), bpe.coder(WORDS)
    for t in texts:
        assert enc.ids(t).tolist() == a.encode(t, add_special_tokens=False).ids
        ids = b.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == (" ".join(map(str, ids)).encode(), b.decode(ids, skip_special_tokens=False).encode())


def test_chunks_are_content_defined():
    rnd = random.Random(3)
    body = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(2000)).encode()
    cut = lambda d: {bytes(d[a:b]) for a, b in zip([0, *bpe.cuts(d)], bpe.cuts(d))}
    assert len(cut(body)) > 5 and len(cut(body) - cut(b"shifted by this " + body)) <= 1


def test_differencing():
    rng = np.random.default_rng(0)
    for n, parts in [(0, 3), (1, 3), (5, 5), (7, 3), (300, 40), (40, 300)]:
        sizes = rng.integers(1, 257, n)
        to = packing.differencing(sizes, parts)
        assert len(to) == n and (not n or (to.min() >= 0 and to.max() < max(parts, 1)))
    sizes = rng.integers(100, 257, 600)
    load = np.bincount(packing.differencing(sizes, 60), sizes)
    assert load.max() - load.min() <= 0.02 * load.mean()
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def plain_differencing(sizes, parts):
    """The largest and least sums by the definition: lists of sums, merged one pair at a time."""
    made = [(sorted([int(n)] + [0] * (parts - 1)), i) for i, n in enumerate(sorted(sizes, reverse=True))]
    at = len(made)
    while len(made) > 1:
        made.sort(key=lambda m: (m[0][0] - m[0][-1], m[1]))
        (a, _), (b, _) = made[:2]
        made = [*made[2:], (sorted(x + y for x, y in zip(a, b[::-1])), at)]
        at += 1
    return max(made[0][0]), min(made[0][0])


def test_differencing_against_the_definition():
    rng = np.random.default_rng(6)
    for n, parts in [(6, 3), (40, 7), (90, 30), (25, 40)]:
        sizes = rng.integers(1, 5000, n)
        load = np.bincount(packing.differencing(sizes, parts), sizes, parts)
        assert (load.max(), load.min()) == plain_differencing(sizes.tolist(), parts)


def test_windows_hold_whole_documents_where_they_can():
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 2048, 700), np.full(50, 1400), np.array([2047, 1]), np.array([5]), np.full(9, 2047)):
        f = packing.fitted(np.sort(sizes)[::-1], 2048)
        assert np.bincount(f[:, 3], f[:, 2]).max() <= 2048
        assert np.bincount(f[:, 0], f[:, 2]).tolist() == np.sort(sizes)[::-1].tolist()
        for i in range(len(sizes)):  # an item's rows follow on each other
            own = f[f[:, 0] == i]
            own = own[np.argsort(own[:, 1])]
            assert own[0, 1] == 0 and (own[1:, 1] == own[:-1, 1] + own[:-1, 2]).all()
        assert len(set(f[:, 3])) <= -(-sizes.sum() // 2048) * 1.01 + 1
    assert len(packing.fitted(rng.integers(1, 2048, 700), 2048)) <= 1.3 * 700


def test_packing_is_whole(spark):
    texts = corpus(50, 3) + [" ".join(map(str, range(6000))), None]
    tk = Tokenizer.from_file(BYTES)
    rows = sorted(packing.pack(documents(spark, texts), BYTES, group=4096, with_ids=True).collect())
    fill: dict = {}
    for d, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in rows if r.doc_id == d]
        assert b"".join(r.ids for r in mine) == ids.tobytes() and {r.doc_tokens for r in mine} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


def test_gradients_by_differences():
    m = langid.new_model(["a", "b", "c"], 3, 1, np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    _, grads = langid.loss_and_gradients(m, x, y)
    for p, g in zip(m.params(), grads):
        for i in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:4]]:
            old = p[i]
            p[i] = old + 1e-6
            up = langid.loss_and_gradients(m, x, y)[0]
            p[i] = old - 1e-6
            down = langid.loss_and_gradients(m, x, y)[0]
            p[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_inference_equals_the_training_pass():
    m = langid.new_model(["a", "b"], 4, 2)
    text = bytes(np.random.default_rng(1).integers(97, 123, 300).astype(np.uint8))
    f, _ = langid._forward(m.sides[0], np.frombuffer(text[:128], np.uint8)[:, None])
    b, _ = langid._forward(m.sides[1], np.frombuffer(text[:128], np.uint8)[::-1, None])
    z = f[:, 0] @ m.out[0] + b[::-1, 0] @ m.out[1] + m.bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(langid.probabilities(m, [text[:128]])[0], (p / p.sum(1, keepdims=True)).mean(0), atol=1e-5)
    assert np.allclose(langid.probabilities(m, [text, b"", text])[[0, 2]].sum(1), 1) and langid.probabilities(m, [b""]).sum() == 0


def test_letters_are_those_of_unicode():
    import unicodedata

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    wrong = [c for c in every if bool(langid.LETTER.search(c)) != unicodedata.category(c).startswith("L")]
    assert not wrong and not langid.LETTER.search("\u00bd \u00b2 \u2462")


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) >= 0.9


def plain_scores(texts, good, vocabulary):
    """Losses of each text by the definition: counts of all other texts, one by one."""
    words = [[w.lower() for w in (t or "").encode().split()] for t in texts]
    n = {}
    for ws in words:
        for w in ws:
            n[w] = n.get(w, 0) + 1
    known = set(sorted((w for w in n if n[w] > 1), key=lambda w: -n[w])[:vocabulary])
    out = []
    for i, own in enumerate(words):
        sums = []
        for model in (0, 1):
            uni, bi = {}, {}
            for t in (t for j, t in enumerate(words) if j != i and (not model or j in good)):
                for a, b in zip([None, *t], t):
                    uni[b if b in known else None] = uni.get(b if b in known else None, 0) + 1
                    bi[a, b] = bi.get((a, b), 0) + (b in known)
            total, loss = sum(uni.values()), 0.0
            for a, b in zip([None, *own], own):
                p = (uni.get(b if b in known else None, 0) + lmscore.ADDED) / (total + lmscore.ADDED * (len(known) + 1))
                if a in known:
                    p = (bi.get((a, b), 0) + lmscore.BACKOFF * p) / (uni.get(a, 0) + lmscore.BACKOFF)
                loss -= np.log(p)
            sums.append(loss / len(own) if own else None)
        out.append(sums)
    return out


def test_scores_against_the_definition(spark):
    texts = corpus(40, 5) + [None, "", "Once only words", "ONCE only words"]
    good = {i for i in range(len(texts)) if i % 3 == 0}
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in lmscore.score(docs, docs.where("doc_id % 3 = 0")).collect()}
    for i, (b, t) in enumerate(plain_scores(texts, good, 1 << 18)):
        assert got[i].n_tokens == len((texts[i] or "").split())
        if b is None:
            assert got[i].loss_background is None and got[i].score is None
        else:
            assert np.isclose(got[i].loss_background, b, atol=1e-9) and np.isclose(got[i].loss_target, t, atol=1e-9) and np.isclose(got[i].score, t - b, atol=1e-9)


@pytest.mark.parametrize("common", [0, 40, 1 << 20])
def test_scores_whether_bigrams_are_common_or_met(spark, monkeypatch, common):
    monkeypatch.setattr(lmscore, "BUCKET", 500)
    monkeypatch.setattr(lmscore, "HELD", 900)
    texts = corpus(40, 5) + ["\u00c9 \u0130stanbul  a\tA\x0b b ", "\u00e9 a A", "a b " * 400]
    docs = documents(spark, texts)
    marked = docs.selectExpr("doc_id as key", "text", "doc_id % 3 = 0 as target")
    got = {r.key: r for r in lmscore.losses(Workspace(spark, "test"), marked, common=common).collect()}
    for i, (b, t) in enumerate(plain_scores(texts, {i for i in range(len(texts)) if i % 3 == 0}, 1 << 18)):
        assert np.isclose(got[i].background / got[i].words, b, atol=1e-9) and np.isclose(got[i].target / got[i].words, t, atol=1e-9)


def test_scores_order_texts(spark):
    docs = documents(spark, ["good words are here " * 5] * 20 + ["zz qq " * 9] * 20)
    got = {r.doc_id: r for r in lmscore.score(docs, docs.where("doc_id < 10")).collect()}
    assert max(got[i].score for i in range(20)) < 0.05 and min(got[i].score for i in range(20, 40)) > 1


def test_pipeline_against_plain_stages(spark, small):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "PII", "packing"]
    ws = Workspace(spark, "test")
    rows = {r.doc_id: r for r in ws.table(stages["language ID"](spark, docs, small)).collect()}
    assert len(rows) >= 0.98 * docs.count()
    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    fps = {i: simhash.fingerprint(r.text) for i, r in rows.items()}
    parent = {i: i for i in fps}
    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    once = ws.table(stages["SimHash near-dedup"](spark, kept, small))
    ids = [i for i in ids if find(parent, i) == i]
    assert sorted(r.doc_id for r in once.collect()) == ids and once.columns == docs.columns
    clean = ws.table(stages["substring dedup"](spark, once, small))
    want = {i: (rows[i].text if not gone else text) for i, (n, gone, text) in zip(ids, plain_removal([rows[i].text for i in ids])) if not gone or gone < n}
    assert {r.doc_id: r.text for r in clean.collect()} == want and all(r.n_chars == len(r.text) for r in clean.collect())
    safe = {r.doc_id: r.text for r in ws.table(stages["PII"](spark, clean, small)).collect()}
    assert safe.keys() == want.keys() and not any(valid(k, m.group()) for t in safe.values() for k, p in PLAIN[:1] for m in re.finditer(p, t))
    packed = C.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(want)


def test_digest_of_kept_words(spark, small):
    got = {r.doc_id: r for r in substrings.op3_substring_dedup(spark, small).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    for (i, _), (n, gone, text) in zip(docs, plain_removal([t for _, t in docs])):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
