import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tests.llm.helpers import DOC, ODD, texts
from tokenizers import Tokenizer

import public_tokenizers
from loomstat.llm import components, fingerprints, katz, packing, pieces, quality, secrets, simhash


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_keep_every_component_also_in_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COLD", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:3]:  # clouds around three of them
        for _ in range(70):
            x = centre
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["component"] for r in components.components(simhash.links(nodes)).collect()}
    want = brute_components(signed)
    groups, got = defaultdict(set), defaultdict(set)
    for v, w in zip(signed, want, strict=True):
        groups[w].add(v)
        got[found.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_edge_cases(spark):
    rows = texts(spark, [(*r, "x", 1) for r in ODD], DOC + ", fp string, component_id int")
    found = simhash.near_duplicates(rows).collect()
    assert len(found) == len(ODD)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fp"] == by[2]["fp"] == by[7]["fp"] == 0 and by[7]["component_id"] == 1
    assert simhash.near_duplicates(texts(spark, [])).count() == 0
    assert np.uint64(by[3]["fp"] % 2**64) == simhash.xxhash.xxh64_intdigest(b"a", 42)


def test_similar_texts_link_at_a_jaccard_index(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(0, 90, 3):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice((60, 200, 900)))]
        near, far = list(words), list(words)
        near[len(near) // 2] = "changed"
        for i in range(0, len(far), 8):
            far[i] = f"f{rng.randint(0, 10**6)}"
        rows += [(k, " ".join(words)), (k + 1, " ".join(near)), (k + 2, " ".join(far))]
        want |= {k: k, k + 1: k, k + 2: k + 2}
    rows += [(1000, None), (None, rows[0][1])]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(texts(spark, rows), words=5, similarity=0.8).collect()}
    assert found == want | {1000: 1000, None: 0}
    assert simhash.near_duplicates(texts(spark, []), words=5, similarity=0.8).count() == 0


def brute_similar(rows, words=5, similarity=0.8):
    """Smallest id reachable over links at three bits or at the Jaccard index."""
    sets = {k: set(simhash.shingle_hashes(t or "", words).tolist()) for k, t in rows}
    fps = {k: simhash.fingerprint(simhash.shingle_hashes(t or "", words)) % 2**64 for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        either = len(sets[a] | sets[b])
        if (fps[a] ^ fps[b]).bit_count() <= 3 or (either and 5 * len(sets[a] & sets[b]) >= 4 * either):
            one, two = sorted((find(a), find(b)))
            root[two] = one
    return {k: find(k) for k in root}


@pytest.mark.parametrize(("cold", "block", "frequent"), [(16, 1024, 4), (2, 8, 99)])
def test_no_similar_pair_is_missed(spark, monkeypatch, cold, block, frequent):
    """Short texts at the very index, chains, a passage that many share, blocks of large groups."""
    for name, value in (("COLD", cold), ("SET_BLOCK", block), ("FREQUENT", frequent), ("SAMPLE", 2)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage = [word() for _ in range(60)]
    rows = []
    for size in (5, 9, 13, 22, 49, 130, 400, 1100):
        for _ in range(6):
            chain = [word() for _ in range(size)] + passage * rng.choice((0, 0, 1))
            for _ in range(rng.choice((2, 3, 5))):
                rows.append((len(rows), " ".join(chain)))
                chain = list(chain)
                lost = max(1, (len(chain) - 4) // 10)
                chain = chain[lost:] + [word() for _ in range(lost)] if rng.random() < 0.7 else chain[: -lost - 1]
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = simhash.near_duplicates(texts(spark, rows), words=5, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_similar(rows)


def test_texts_without_an_id_link_texts(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(5, " ".join(base)), (None, " ".join(base[3:] + ["x", "y", "z"])), (3, " ".join(base[6:] + ["x", "y", "z", "u", "v", "w"]))]
    found = simhash.near_duplicates(texts(spark, rows), words=5, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {5: 3, None: 3, 3: 3}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(found) == {*range(41), 100, 101} and all(found[k] == 0 for k in range(41)) and found[101] == 100
    assert components.components(edges.limit(0)).count() == 0


def brute_katz(docs):
    low = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]
    tokens = [low(t) + [b"\n"] for _, t, _ in docs]
    c, pairs, begins = Counter(), Counter(), Counter()
    for words, (_, _, train) in zip(tokens, docs, strict=True):
        before = b"\t"
        for w in words if train else []:
            c[w] += 1
            pairs[before, w] += 1
            begins[before] += 1
            before = w
    n, counts = sum(c.values()), Counter(c.values())
    d1 = katz.discounts([counts[k] for k in range(1, katz.K + 2)])
    counts = Counter(pairs.values())
    d2 = katz.discounts([counts[k] for k in range(1, katz.K + 2)])
    part = lambda d, r: (d[r - 1] if r <= katz.K else 1.0) * r
    unknown = 1 - sum(part(d1, x) for x in c.values()) / (n + 1)
    p1 = lambda w: part(d1, c[w]) / (n + 1) if c[w] else unknown
    taken, covered = Counter(), Counter()
    for (h, w), x in pairs.items():
        taken[h] += part(d2, x) / (begins[h] + 1)
        covered[h] += p1(w)

    def p(h, w):
        if pairs[h, w]:
            return part(d2, pairs[h, w]) / (begins[h] + 1)
        return ((1 - taken[h]) / (1 - covered[h]) if begins[h] else 1.0) * p1(w)

    out = []
    for words in tokens:
        out.append((sum(math.log10(p(h, w)) for h, w in zip([b"\t", *words], words, strict=False)), sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in words), len(words), sum(c[w] > 0 for w in words), n))
    return out, p, list(c)


@pytest.mark.parametrize("small", [False, True])
def test_katz_equals_brute_force(spark, monkeypatch, small):
    if small:  # many chunks and buckets, and hot histories
        monkeypatch.setattr(katz, "CHUNK_BYTES", 900)
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 200)
        monkeypatch.setattr(katz, "HOT_SHARE", 40)
        monkeypatch.setattr(katz, "HOT_LEAST", 5)
    rng = random.Random(3)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.7))}" if rng.random() < 0.6 else "The" for _ in range(rng.randint(0, 60))), k % 3 > 0) for k in range(150)]
    docs += [(500, None, True), (501, "", False), (None, "the w1", True), (1, docs[1][1], True)]
    got = katz.score(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, train boolean, score string")).collect()
    want, p, vocabulary = brute_katz(docs)
    key = lambda d: (d[0] is None, d[0] or 0)
    rows = sorted(((r["doc_id"], r["score"], r["base_score"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=key)
    wanted = sorted(((d[0], *w) for d, w in zip(docs, want, strict=True)), key=key)
    assert [r[0] for r in rows] == [w[0] for w in wanted]
    for r, w in zip(rows, wanted, strict=True):
        assert r[1:3] == pytest.approx(w[1:3], abs=1e-8) and r[3:] == w[3:]
    for h in (b"the", b"w1", b"\t", b"never"):
        assert sum(p(h, w) for w in [*vocabulary, b"unseen"]) == pytest.approx(1, abs=1e-9)


def test_stored_katz_tables_score_other_texts(spark):
    rng = random.Random(11)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 50))), True) for k in range(120)]
    model = katz.train(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, train boolean, count string"))
    _, p, _ = brute_katz(docs)
    other = [(1, "w1 w2 W3 w1"), (2, None), (3, ""), (4, "never seen w1 w1 w1"), (None, "w5 w9 w1"), (1, "w1 w2 W3 w1"), *((k, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(20))) for k in range(10, 40))]
    want = Counter()
    for k, t in other:
        words = [w.encode().lower() for w in (t or "").split()] + [b"\n"]
        want[k, len(words), round(sum(math.log10(p(h, w)) for h, w in zip([b"\t", *words], words, strict=False)), 6)] += 1
    got = katz.evaluate(model, spark.createDataFrame([(*r, 1) for r in other], DOC + ", n int")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in got) == want
    assert katz.evaluate(model, texts(spark, [])).count() == 0


def test_katz_without_training_or_rows(spark):
    row = katz.score(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")).first()
    assert (row["score"], row["n_tokens"], row["n_known"]) == (0.0, 3, 0)
    assert katz.score(spark.createDataFrame([], "doc_id long, text string, train boolean")).count() == 0


def odd_texts(n=400):
    rng = random.Random(1)
    some = ["", "  ", "a  b", "▁a ▁▁b", " lead", "trail ", "é😀 日本\n\n\tx", "<s> </s> <0x0A>", "don't STOP now. Yes,", "  \n  \n", "x\x00y", "<|endoftext|> <|ENDOFTEXT|>", "İstanbul ΣΑΣ straße"]
    return some + ["".join(rng.choice("ab  the ▁\n éñingß0x{}()'日…tion.") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_pieces_equal_the_library(tmp_path, kind):
    path = public_tokenizers.path("piece_bpe_32k.model")
    if kind == "unigram":  # the same pieces and scores under the other search
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        proto.trainer_spec.model_type = 1
        path = str(tmp_path / "unigram.model")
        open(path, "wb").write(proto.SerializeToString())
    model, library, some = pieces.Model(path), SentencePieceProcessor(model_file=path), odd_texts()
    want = library.encode(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(some)] == want
    assert [model.decode(np.array(w, "<u4").tobytes()) for w in want] == [library.decode(w) for w in want]


def test_pieces_on_odd_rows(spark):
    rows = texts(spark, [(*r, b"old") for r in ODD], DOC + ", ids binary")
    out = pieces.decode(pieces.encode(rows)).collect()
    assert len(out) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in out)


def test_first_fit_decreasing_equals_the_plain_rule():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        room, want = [], [None] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            if b == len(room):
                room.append(100)
            want[k] = (b, 100 - room[b])
            room[b] -= sizes[k]
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_packing_is_whole(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts(60))] + ODD
    out = packing.pack(texts(spark, rows), group_docs=20).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            piece = ids[start : start + 4096]
            want[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(texts(spark, [])).count() == 0


PATTERN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "API_KEY", "apikey", " = ", ":", '"', "'", "abc", "secret=token : abcdefgh", "AKIA", "ABCDEFGH1234567890", "deadbeef" * 3, "0123456789abcdef" * 2, " ", "é😀", "\n", "x=y"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for k in range(300)] + ODD
    ratios = secrets.fit(secrets.labelled(spark))
    for r in secrets.scan(texts(spark, [(*x, 1) for x in rows], DOC + ", spans int"), ratios).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base_spans(r["text"] or "")
        assert all(b in [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for b in base_spans(r["text"] or ""))


def test_markov_models_and_redaction(spark):
    ratios = secrets.fit(secrets.labelled(spark))
    key = "q9Zx7Lm2Vt8Kp4Rw6Yb1Nd3Hs"
    docs = texts(spark, [(1, f"see {key} there"), (2, "get_user_name_2024-05-17 and utf8_general_ci_0001"), (3, f'token = "{"ab12" * 10}" end'), (4, None), (5, "internationalisation of words")])
    out = {r["doc_id"]: r for r in secrets.scan(docs, ratios).collect()}
    assert [s["kind"] for s in out[1]["spans"]] == [3] and not out[2]["spans"] and not out[5]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, ratios).collect()}
    assert clean[1] == "see [secret] there" and clean[3] == '[secret]" end' and clean[4] is None


def passages(text):
    return {p for p in re.split(r"(?<=[.!?|])[ \t\n\x0b\f\r]+|\n", text) if p.strip(" \t\n\x0b\f\r")}


def test_fingerprints_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    make = lambda n: " ".join(f"s{rng.randint(0, 400)} word." for _ in range(n))
    rows = [(k, make(rng.choice((0, 1, 3, 20, 150)))) for k in range(60)] + [(99, rows_text := make(900)), (100, rows_text), (101, None), (102, ""), (103, "x" * 50_000)]
    path = str(tmp_path)
    texts(spark, [(*r, "z") for r in rows], DOC + ", a string").write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.query(spark, path).collect()}
    ids = sorted((k for k, _ in rows), reverse=True)
    after, text = dict(zip(ids, ids[1:] + ids[:1], strict=True)), {k: t or "" for k, t in rows}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, t in text.items():
        n, cut = len(t), len(t) // 3
        edited = t[: n - cut] + text[after[k]][:cut]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["near_edited"] == pytest.approx(like(passages(t), passages(edited))) and got[k]["near_next"] == pytest.approx(like(passages(t), passages(text[after[k]])))
    assert got[99]["fingerprint"] == got[100]["fingerprint"] != got[103]["fingerprint"]


def test_quality_on_held_out_rows_and_odd_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in quality.query(spark, sf_dir).where("held_out").collect() if r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = quality.scores(texts(spark, [(*r, "old") for r in ODD], DOC + ", score string"), model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    empty = quality.fit(texts(spark, []).selectExpr("doc_id", "text", "1 AS quality"))
    assert {r["score"] for r in quality.scores(texts(spark, ODD), empty).collect()} == {0.5}


def test_secrets_beside_base_spans_in_one_run(spark):
    key, other, word = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMI7K3MDENGbPxRfiCY9QzLp2Vt8Hs", "backup_2024_user_report"
    digest = "0123456789abcdef01234567"
    rows = [(1, f"é {key}/{other} end"), (2, f"{digest}-{other}"), (3, f"{other}-{digest}/{other}"), (4, f"{digest}/{word}"), (5, f"{digest}-{other[:14]}"), (6, None)]
    ratios = secrets.fit(secrets.labelled(spark))
    found = {r["doc_id"]: r for r in secrets.scan(texts(spark, rows), ratios).collect()}
    spans = lambda k: [(secrets.KINDS[x["kind"]], dict(rows)[k][x["start"] : x["end"]]) for x in found[k]["spans"]]
    assert spans(1) == [("access", key), ("random", "/" + other)] and spans(2) == [("hex", digest), ("random", "-" + other)]
    assert spans(3) == [("random", other + "-"), ("hex", digest), ("random", "/" + other)]
    assert spans(4) == [("hex", digest)] == spans(5) and found[6]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(texts(spark, rows), ratios).collect()}
    assert all(other not in clean[k] and digest not in clean[k] for k in (1, 2, 3)) and word in clean[4]


def test_random_runs_of_letters_alone(spark):
    rng = random.Random(3)
    ordinary = ["getUserSessionConfigHandler", "internationalisation", "Geschwindigkeitsbegrenzung", "anticonstitutionnellement", "desafortunadamente", "path/to/the/message/factory", "MAX_REQUEST_BUFFER_VALUE", "2024-05-17/00012345"]
    rows = list(enumerate(ordinary)) + [(100 + k, "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=20))) for k in range(100)]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(texts(spark, rows), secrets.fit(secrets.labelled(spark))).collect()}
    assert not any(found[k] for k in range(len(ordinary))) and sum(len(found[k]) for k in range(100, 200)) >= 97


def test_fingerprints_of_null_negative_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Order: descending id, then descending hash of the text, null ids last; equal rows follow one another."""
    monkeypatch.setattr(fingerprints, "KEYS", 2)
    hashed = spark.createDataFrame([(k, f"s{k} one. two. s{k % 7} three. end{'x' * (k % 13)}.") for k in range(120)], "k long, text string").selectExpr("k", "text", "xxhash64(text) AS h").collect()
    hash_of = {r["text"]: r["h"] for r in hashed}
    some = [r["text"] for r in hashed]
    rows = [(k - 20, t) for k, t in enumerate(some[:40])] + [(5, t) for t in some[40:70]] + [(None, t) for t in some[70:100]] + [(7, some[100])] * 25 + [(2**63 - 1, some[101]), (-(2**63) + 1, some[102])]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of[r[1]]), reverse=True)
    want = Counter()
    for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        like = lambda a, b: round(len(a & b) / len(a | b), 9)
        want[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(passages(t), passages(edited)), like(passages(t), passages(after))] += 1
    got = fingerprints.query(spark, f"{tmp_path}/a").collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fingerprints.query(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("sides", [(0, 0), (1, 0), (3, 5), (40, 60), (700, 650)])
def test_sketches_give_the_differing_digests(spark, sides):
    rng = random.Random(sum(sides))
    both, a, b = ([rng.getrandbits(63) for _ in range(n)] for n in (50, *sides))
    rows = spark.createDataFrame([(both + a, b + both)], "a array<long>, b array<long>").select("a", "b", F.expr(fingerprints.sketch("a")).alias("sa"), F.expr(fingerprints.sketch("b")).alias("sb"))
    found = rows.select(F.expr(fingerprints.difference("a", "b", "sa", "sb")).alias("d")).first()["d"]
    assert sorted(found["a"]) == sorted(a) and sorted(found["b"]) == sorted(b)


def test_quality_scores_follow_from_compressed_sizes():
    """Sizes by plain calls of the library, and the score from differences alone."""
    rng = random.Random(9)
    good, bad = ([" ".join(rng.choice(words) for _ in range(rng.randint(5, 200))) for _ in range(60)] for words in (["river", "stone", "morning", "letter"], ["buy", "now", "click", "!!!", "free"]))
    dicts = [quality._dictionary([t.encode() for t in texts]) for texts in (good, bad)]
    measure = quality.Measure(*(d.as_bytes() for d in dicts), tuple(not d.dict_id() for d in dicts))
    model = quality.Model(*(d.as_bytes() for d in dicts), tuple(not d.dict_id() for d in dicts), np.array([0.1, 0.0, 0.0, 0.0]), np.ones(4), np.array([0.5, 2.0, 1.0, 0.3, -0.2]))
    score = model.scorer()
    for text in ["", "river stone", "buy now " * 300, "é" * 1000, "\n".join(good[:9] + bad[:2])]:
        data, n = text.encode(), max(1, round(len(text.encode()) / quality.BLOCK))
        blocks = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
        sizes = []
        for d in dicts:
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append([len(c.compress(x)) - len(c.compress(b"")) for x in blocks])
        whole, total = sum(sizes[1]) - sum(sizes[0]), sum(sizes[1]) + sum(sizes[0])
        each = [(b - g) / (b + g + 16) for g, b in zip(*sizes, strict=True)]
        features = [whole / (total + 16), min(each), max(each), whole / (len(data) + 16)]
        assert measure(text).tolist() == pytest.approx(features)
        margin = 0.5 + 2.0 * (features[0] - 0.1) + features[1] + 0.3 * features[2] - 0.2 * features[3]
        assert score(text) == pytest.approx(1 / (1 + math.exp(-margin)))
    assert score("morning letter river stone " * 20) > score("click free now " * 20)


def test_quality_learns_from_whole_texts_and_no_more_than_the_bound(spark, monkeypatch):
    """What tells the labels apart lies at the ends of texts with a common head."""
    rng = random.Random(2)
    head = " ".join(f"h{k}" for k in range(400))
    tail = lambda label: " ".join(rng.choice(["amber", "harbour", "lantern", "meadow"] if label else ["xqz!", "win$$", "clck", "frree"]) for _ in range(80))
    rows = [(k, f"{head} {tail(k % 2)}", k % 2) for k in range(200)] + [(None, "no id", 1), (5, None, 1), (7, "x" * 3_000_000, 0)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    score = model.scorer()
    assert min(score(f"{head} {tail(1)}") for _ in range(20)) > max(score(f"{head} {tail(0)}") for _ in range(20))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 0)
    assert not quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int")).good


def test_secrets_in_very_long_texts_and_empty_tables(spark):
    rng = random.Random(5)
    runs = ["%032x" % rng.getrandbits(128) for _ in range(16_000)]
    text = "é " + " ".join(runs) + " 日本 end"
    ratios = secrets.fit(secrets.labelled(spark))
    began = time.time()
    found = secrets.scan(texts(spark, [(1, text), (1, text)]), ratios).collect()
    assert time.time() - began < 30 and len(found) == 2
    for r in found:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base_spans(text)
    clean = secrets.redact(texts(spark, [(1, text)]), ratios).first()["text"]
    assert clean == "é " + " ".join(["[secret]"] * len(runs)) + " 日本 end"
    assert secrets.scan(texts(spark, []), ratios).count() == 0 and secrets.redact(texts(spark, []), ratios).count() == 0


def test_markov_ratio_on_strings_held_out(spark):
    """Neither parts nor forms of the ordinary strings, nor the random ones, were learnt from."""
    rows = secrets.held_out(spark).where("length(text) >= 16 AND text RLIKE '[A-Za-z]'")
    found = rows.select("random", (F.expr(secrets._ratio("text", secrets.fit(secrets.labelled(spark)))) > secrets.THRESHOLD).alias("taken")).groupBy("random", "taken").count().collect()
    n = defaultdict(int, {(r["random"], r["taken"]): r["count"] for r in found})
    assert n[1, True] / (n[1, True] + n[1, False]) >= 0.98 and n[1, True] / (n[1, True] + n[0, True]) >= 0.95


def test_exploded_rows_are_not_broadcast_by_their_estimate(spark, monkeypatch):
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    pairs_of_cells = simhash.links(fps)._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Generate" in pairs_of_cells and "BroadcastHashJoin" not in pairs_of_cells


def test_shingles_and_partial_keys_are_not_broadcast(spark, monkeypatch):
    plans, stored = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, *a, **k: (plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()), stored(df, name, *a, **k))[1])
    docs = texts(spark, [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(60))) for k in range(40)])
    simhash.near_duplicates(docs, words=5, similarity=0.8)
    assert all("SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name] for name in ("simhash-pairs", "simhash-members"))
