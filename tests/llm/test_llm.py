"""The operators against brute force, other libraries and hand-made hard cases, on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackpool.llm import bpe, brown, dualtree, minmax, packing, quality, rpforest, secrets, shards, unigram

WORD_BPE, RANKS, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
HARD = [None, "", " ", "\n\t ", "one", "The the THE", "a b c", "a b c d", "naïve Ünïcode 日本語 👩‍👩‍👧 ﬁ", "don't it's 'S\x00x\x1cy\x85z", "<|endoftext|> x<|endoftext|>",
        "aaaa" * 90, "!" * 700, "ab" * 400, "word " * 3000, "a▁b  c", "x" * 1100]


def frame(spark, texts, start=0):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or ""), 1, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, sig string")


def prose(n, seed=0, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return [" ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randint(1, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def hard(spark):
    docs = frame(spark, HARD)
    # a repeated row and a row without key
    extra = spark.createDataFrame([(5, "The the THE", "en", "s", 11, 1, "s"), (None, "lost key", "en", "s", 8, 1, "s")], docs.schema)
    return docs.unionByName(extra).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(hard):
    return hard.limit(0)


# --- sharding ---------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_feistel_permutes_and_inverts(n):
    there = shards.permute(np.arange(n), n, seed=3)
    assert sorted(there.tolist()) == list(range(n))
    assert shards.permute(there, n, seed=3, back=True).tolist() == list(range(n))
    if n == 1000:
        assert there.tolist() != shards.permute(np.arange(n), n, seed=4).tolist()


def test_shards_are_even_and_computable(spark, hard, nothing):
    out = shards.shard_rows(hard, 8).collect()
    assert len(out) == len(HARD) + 2
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert all(shards.row_of(r["shard"], r["slot"], len(out)) == r["row_no"] for r in out)
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(HARD):
        raw = (t or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert shards.shard_rows(nothing).count() == 0
    again = shards.shard_rows(hard.repartition(5), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


# --- token counts -------------------------------------------------------------------------

def test_counts_equal_the_unigram_tokenizer(spark, hard, nothing):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(f"\x01{i}" if model.is_control(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    other = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    other.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = HARD + prose(60)
    out = {r["doc_id"]: r for r in unigram.count_tokens(frame(spark, texts), PIECES).collect()}
    want = [len(e.ids) for e in other.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [out[i]["n_tokens"] for i in range(len(texts))] == want
    assert unigram.count_tokens(hard, PIECES).count() == len(HARD) + 2 and unigram.count_tokens(nothing, PIECES).count() == 0


def test_viterbi_ties_and_unknowns_by_hand():
    c = unigram.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bb", -1.5)], True, False)
    # equal ways: the longer last piece stays; an unknown counts its bytes
    assert c.chunk("ab") == (-2.0, 1) and c.chunk("abb") == (-2.5, 2) and c.chunk("aé") == (-1.0 + c.unknown, 3)
    with pytest.raises(ValueError):
        unigram.Counter([("a▁b", -1.0)], True, True)


# --- language model -------------------------------------------------------------------------

def base_scores(texts, train):
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    counts = Counter(w for k, t in enumerate(tokens) if train[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


def test_language_model_base_and_gain(spark):
    texts = HARD + prose(300)
    docs = frame(spark, texts)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    out = {r["doc_id"]: r for r in brown.score_texts(docs, docs.filter(~brown.held_out(2, 7)), classes=8, rounds=4).collect()}
    n, want = base_scores(texts, train)
    for i, (tokens, known, base) in enumerate(want):
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [i for i in range(len(HARD), len(texts)) if not train[i]]
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)


def test_language_model_without_training_or_documents(spark, hard, nothing):
    assert brown.score_texts(nothing, hard).count() == 0
    rows = brown.score_texts(hard, nothing).collect()
    assert len(rows) == len(HARD) + 2 and all(r["score"] == r["base_score"] == 0.0 and r["train_tokens"] == 0 for r in rows)


def test_emissions_and_transitions_are_distributions(spark):
    docs = frame(spark, prose(200))
    plain = docs.select("doc_id", "text")
    model, counts, _ = brown.train(plain, classes=8, rounds=3)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1.0)
    words = [(r["word"], r["c"]) for r in counts.collect() if r["word"] != brown.END]
    kinds = model.classes[model.units.of(pa.array([w for w, _ in words]))]
    mass = np.bincount(kinds, weights=10 ** model.emission(np.array([c for _, c in words]), kinds), minlength=8)
    for k in set(kinds.tolist()):
        unseen = model.unseen_types[k] * 10 ** model.unseen[k] if model.discount[k] > 0 else 0.0
        assert mass[k] + unseen == pytest.approx(1.0, abs=1e-9)


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 9, (7, 7)).astype(float)          # bigrams of units, unit 0 the end
    classes, size = np.array([0, 1, 1, 2, 2, 3, 3]), 4

    def counts(of):
        out = np.zeros((size, size))
        np.add.at(out, (of[:, None], of[None, :]), table)
        return out
    for unit in range(1, 7):
        right, left = (np.bincount(classes, weights=x, minlength=size) for x in (table[unit], table[:, unit]))
        best, gain = brown.best_class(counts(classes), right, left, table[unit, unit], classes[unit])
        values = []
        for c in range(1, size):
            moved = classes.copy()
            moved[unit] = c
            values.append(brown.likelihood(counts(moved)))
        assert brown.likelihood(counts(classes)) + gain == pytest.approx(max(values)) and values[best - 1] == pytest.approx(max(values))


# --- secrets --------------------------------------------------------------------------------

def test_base_patterns():
    text = 'API_KEY: "abcdef123" token=abc PassWord = secret=hunter22 AKIA' + "A" * 16 + " " + "0f" * 12 + "g toKen=x"
    base, _ = secrets.scan(text)
    found = [(secrets.KINDS[k], text[a:b]) for a, k, b in base]
    assert found == [("assign", 'API_KEY: "abcdef123'), ("assign", "PassWord = secret=hunter22"), ("access", "AKIA" + "A" * 16), ("hex", "0f" * 12)]
    assert secrets.base_spans("toKen=abcdefgh ſecret=abcdefgh") == []


def test_constants_reach_sensitive_names():
    text = 'X = "q8Zk2LmP0v"\ny = X\nconn.password = y\ntitle = "q8Zk2LmP0w"\n{"client_secret": "Zx81-kk_02Lq"}\ncfg["db_password"] = \'aB3$\' + \'xY9!zz\''
    _, spans = secrets.scan(text)
    found = [text[a:b] for a, k, b in spans if secrets.KINDS[k] == "pair"]
    assert found == ["q8Zk2LmP0v", "Zx81-kk_02Lq", "aB3$", "xY9!zz"]


def test_prose_is_left_alone():
    for text in ("Note: this is the key to the token economy.", "The password: please change it", "ratio = height / width", "see http://a.b/c?key=none", "secret = password"):
        assert not [1 for _, k, _ in secrets.scan(text)[1] if secrets.KINDS[k] == "pair"]


def pair_literals(text):
    return [text[a:b] for a, k, b in secrets.scan(text)[1] if secrets.KINDS[k] == "pair"]


@pytest.mark.parametrize("text,found", [
    ('title: str = "Xk29fjq0w9Zq"\npassword: str = ""', []),
    ('password: Optional[str] = "Xk29fjq0w9Zq"', ["Xk29fjq0w9Zq"]),
    ('prefix = "p"\npassword = prefix + "aB3$kdk29sQ"', ["aB3$kdk29sQ"]),
    ("export DB_PASSWD=hunter2abcX9\nsecret: abc/def+99Zq==\n", ["hunter2abcX9", "abc/def+99Zq=="]),
    ('<password>aB3$kdk29sQ</password> <add key="ApiToken" value="zZ91kkq0Pw1"/>', ["aB3$kdk29sQ", "zZ91kkq0Pw1"]),
    ("it's password = 'aB3$kdk29sQ' don't", ["aB3$kdk29sQ"]),
    ("log: password=aB3$kdk29sQ!", ["aB3$kdk29sQ!"]),
    ('password = """aB3$kdk29sQ"""', ["aB3$kdk29sQ"]),
    ('x = "Old9fjq0w9Zq"\nx = "plain"\npassword = x\n', []),
    ('password = x\nx = "Old9fjq0w9Zq"\n', ["Old9fjq0w9Zq"]),
    ('connect(user="bob", password="zZ91kkq0Pw1")', ["zZ91kkq0Pw1"]),
    ("token: get_token2() 12:30 secret = conf.key9", []),
    ('password = "[SECRET]"', []),
    ('password = "never closed aB3$kdk29sQ\ntoken = "zZ91kkq0Pw1"', ["zZ91kkq0Pw1"]),
])
def test_lexer(text, found):
    assert pair_literals(text) == found


@pytest.mark.parametrize("part", ["a:", "a=", 'x="\\"', "ab cd: ", "a='''b", 'p="a"+', "<a>b</", "a: b[", "`'\"=:", "b: c\n", "a.", "=", "a-$", "x"])
def test_scan_time_is_linear(part):
    """A megabyte that a scan which goes back or looks ahead without bound would take hours for."""
    import time
    text = (part * (1_000_000 // len(part) + 1))[:1_000_000] + '=1\npassword = "aB3$kdk29sQ"\n'
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 40


def test_scan_query_columns(spark, hard, nothing):
    texts = HARD + ['my token = "f6f4b6c25fd9db1a3d0f51bedd389b0833f73c65" é']
    out = {r["doc_id"]: r for r in secrets.digest(secrets.scan_secrets(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base, every = secrets.scan(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest() and out[i]["spans"] == secrets.joined(every)
    last = out[len(texts) - 1]
    assert (last["n_assign"], last["n_access"], last["n_hex"]) == (1, 0, 1)
    assert secrets.scan_secrets(nothing).count() == 0 and secrets.scan_secrets(hard).count() == len(HARD) + 2


def test_redaction_keeps_rows_and_columns(spark):
    docs = frame(spark, [None, "", 'x token = "f6f4b6c25fd9db1a3d0f51bedd389b0833f73c65" y', "clean text"])
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[3]["text"] == "clean text"
    assert got[2]["text"] == 'x [SECRET]" y' and got[2]["n_chars"] == len(got[2]["text"])


# --- packing --------------------------------------------------------------------------------

def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        open_ = [r for r in rooms if r >= n]
        if open_:
            rooms.remove(min(open_))
            rooms.append(min(open_) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed,n,capacity", [(0, 1, 5), (1, 40, 7), (2, 300, 32), (3, 500, 100)])
def test_plan_is_best_fit_decreasing(seed, n, capacity):
    rng = random.Random(seed)
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(n)]
    filled = Counter()
    for length, _, pieces, sequence, each, _ in packing.best_fit_plan(Counter(lengths), capacity):
        for i in range(pieces):
            filled[sequence + i // each] += length
    assert sorted(capacity - v for v in filled.values()) == best_fit(lengths, capacity)
    assert sorted(filled) == list(range(len(filled)))


def test_room_tree_finds_the_tightest():
    rng, tree, rooms = random.Random(4), packing.RoomTree(50), set()
    for _ in range(500):
        r = rng.randint(1, 50)
        (rooms.discard if r in rooms else rooms.add)(r)
        tree.set(r, r in rooms)
        n = rng.randint(1, 50)
        assert tree.tightest(n) == min((x for x in rooms if x >= n), default=None)


def test_pieces_and_places(spark, hard, nothing):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = HARD + prose(80)
    out = packing.pack(frame(spark, texts).repartition(3), WORD_BPE, 64).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(by[i], key=lambda r: r["piece"])
        cuts = [ids[a:a + 64] for a in range(0, len(ids), 64)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, 64 * k, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for k, c in enumerate(cuts)]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == len(best_fit([r["length"] for r in out], 64))
    assert packing.pack(nothing, WORD_BPE).count() == 0 and {r["doc_id"] for r in packing.pack(hard, WORD_BPE).collect()} >= {None, 0}


# --- byte-level BPE ---------------------------------------------------------------------------

def test_coding_equals_tiktoken_and_returns(spark, hard, nothing):
    import tiktoken
    ranks = bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = HARD + prose(60)
    encoded = bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    out = {r["doc_id"]: r for r in bpe.decode(encoded, RANKS).collect()}
    for i, t in enumerate(texts):
        assert out[i]["ids"] == encoding.encode_ordinary(t or "") and bytes(out[i]["bytes"]) == (t or "").encode()
    digest = {r["doc_id"]: r for r in bpe.digest(bpe.round_trip(frame(spark, texts), RANKS, public_tokenizers.PATTERN)).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert (digest[i]["n_tokens"], digest[i]["ids_sha256"], digest[i]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0 and bpe.encode(hard, RANKS, public_tokenizers.PATTERN).count() == len(HARD) + 2
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10 ** 8])], "doc_id long, ids array<int>"), RANKS).collect()


def test_both_ways_of_contraction_agree():
    coder = bpe.Coder(bpe.read_ranks(RANKS))
    words = ["aaaaaaa", "banana" * 9, " thethethe", "!!!!!!!!!!!", "é" * 30, "x"]
    assert coder._contracted(bpe._ENCODE, words) == coder._contracted(bpe._ENCODE_LONG, words)
    # what makes the second way right: every entry encodes to itself
    entries = {b: r for b, r in bpe.read_ranks(RANKS).items() if b.isascii()}
    flat, sizes = coder.encode_words([b.decode() for b in entries])
    assert sizes.max() == 1 and flat.tolist() == list(entries.values())


def test_long_words_equal_the_library(monkeypatch):
    import tiktoken
    ranks, rng = bpe.read_ranks(RANKS), random.Random(5)
    whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks)

    def drawn(n, letters):
        return "".join(rng.choices(letters, k=n))

    def hold(words):
        flat, sizes = coder.encode_words(words)
        for w, ids in zip(words, np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == whole.encode_ordinary(w), w[:80]

    alphabets = ("abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/", "ab", "a", "é日x", "-=", "then ", "01")
    mixed = [drawn(rng.randint(100, 500), a) for a in alphabets for _ in range(12)]
    periodic = [(drawn(rng.randint(1, 9), a) * 400)[:rng.randint(200, 900)] for a in alphabets for _ in range(6)]
    hold(mixed + periodic)
    # words of 40,000 letters, and many of 200, which together go beyond one query
    hold([drawn(40_000, alphabets[0]), "-" * 30_000, "abc" * 10_000] + [drawn(200, alphabets[0]) for _ in range(2_600)])
    # blocks too short to share tokens: bridges, and whole words; queries that stop after four steps
    monkeypatch.setattr(bpe, "BLOCK", 12)
    monkeypatch.setattr(bpe, "STRIDE", 11)
    monkeypatch.setattr(bpe, "QUERY_ROWS", 1)
    hold([w[:150] for w in mixed + periodic if len(w) > 150][::4])


# --- near duplicates ----------------------------------------------------------------------------

def shingles(text, width=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def least_reached(texts, width=4):
    sets, label = [shingles(t, width) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return sets, [root(i) for i in range(len(texts))]


def copies(seed=1):
    """Groups of near copies: stars whose members are far from each other, chains, and repeats."""
    rng, out = random.Random(seed), []
    for base in prose(12, seed, 120):
        words = base.split() * 2
        out.append(" ".join(words))
        for _ in range(rng.choice((0, 1, 6, 20))):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"q{rng.randrange(10 ** 6)}"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
    chain = prose(1, seed + 9, 2)[0].split() + [f"c{i}" for i in range(60)]
    for i in range(12):
        out.append(" ".join(chain))
        chain[5 * i % 50] = f"d{i}"
    return out


def test_near_duplicates_equal_all_pairs(spark):
    texts = HARD + copies()
    sets, label = least_reached(texts)
    out = {r["doc_id"]: r for r in minmax.near_duplicates(frame(spark, texts).repartition(3)).collect()}
    assert [(out[i]["n_shingles"], out[i]["component_id"], out[i]["kept"]) for i in range(len(texts))] == [
        (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label))]


def test_near_duplicate_hard_rows(spark, hard, nothing):
    rows = minmax.near_duplicates(hard).collect()
    assert len(rows) == len(HARD) + 2
    lost = [r for r in rows if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in lost] == [(None, True)]
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    assert minmax.near_duplicates(nothing).count() == 0
    kept = minmax.keep_first(hard)
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and len(ids) == len(set(ids))


def test_blocks_of_one_centre(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 3)
    texts = copies(7)
    _, label = least_reached(texts)
    out = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(frame(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == label


def loosely_similar(n=6000, pairs=400, places=40, seed=3):
    """Texts of ``places`` passages in one of two versions each, some 0.3 alike, and copies of ``pairs`` of them with three other versions."""
    rng = random.Random(seed)
    rows = [[rng.randrange(2) for _ in range(places)] for _ in range(n)]
    for k in range(pairs):
        other = set(rng.sample(range(places), 3))
        rows.append([v ^ (i in other) for i, v in enumerate(rows[k])])
    return [" ".join(f"p{i}v{v}w{j}" for i, v in enumerate(r) for j in range(12)) for r in rows]


def test_pairs_among_loosely_similar_texts(spark):
    texts = loosely_similar()
    sets = [shingles(t) for t in texts[:400] + texts[6000:]]
    assert all(0.8 <= len(sets[k] & sets[400 + k]) / len(sets[k] | sets[400 + k]) < 0.9 for k in range(400))
    assert np.mean([len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(399)]) < 0.4
    out = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(frame(spark, texts)).collect()}
    # others, if any, are alike by chance
    assert [k for k in range(400) if out[k] != out[6000 + k]] == []


def test_min_max_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    perms, found = minmax.permutations(95), []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = np.unique(x[:360]), np.unique(x[40:])       # 320 of 400
        found.append((minmax.signature(a, perms) == minmax.signature(b, perms)).mean())
    assert abs(np.mean(found) - 0.8) < 0.02 and np.std(found) < math.sqrt(0.8 * 0.2 / 190) * 1.3


# --- vectors ----------------------------------------------------------------------------------------

def vectors(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).astype(np.float32).round(2)
    x[n // 3: 2 * n // 3] = x[0]                                    # a third are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 2, [float("nan")] * 6), (n + 3, [float("inf")] + [0.0] * 5), (n + 4, [0.0] * 6), (n + 5, []),
             (None, [1.0] * 6), (n + 6, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3), x


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    df, x = vectors(spark)
    whole = np.vstack([np.floor(256 * x.astype(np.float64)), np.zeros(6)])
    ids = np.array([*range(len(x)), len(x) + 4])
    out = dualtree.top_k(df, df.filter("vec_id % 50 = 0"), k=5, chunk=64).collect()
    for q in range(0, len(x), 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert got == [(k + 1, int(ids[i]), int(scores[i])) for k, i in enumerate(order)]
    few = df.filter("vec_id < 3")
    assert dualtree.top_k(few, few, k=5).count() == 6 and dualtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_cover_tree_invariants():
    points = np.random.default_rng(2).normal(size=(300, 3)).round(1)
    tree = dualtree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(300))
    for i in range(len(tree.begin)):
        inside = tree.points[tree.begin[i]:tree.end[i]]
        assert np.sqrt(((inside - tree.centres[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        kids = range(tree.first[i], tree.last[i])
        if kids:
            assert tree.begin[kids[0]] == tree.begin[i] and tree.end[kids[-1]] == tree.end[i]
            gaps = [np.sqrt(((tree.centres[a] - tree.centres[b]) ** 2).sum()) for a in kids for b in kids if a < b]
            assert min(gaps, default=np.inf) >= tree.radius[i] / dualtree.BASE / (1 + 1e-6) - 1e-5


def test_forest_finds_neighbours(spark):
    df, x = vectors(spark, 900, 3)
    x = x.astype(np.float64)
    queries = df.filter("vec_id % 100 = 0")
    # more leaves than a search opens
    out = rpforest.nearest(df, queries, k=10, trees=6, leaf=16, visits=60).collect()
    hits = total = 0
    for q in range(0, 900, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        order = np.lexsort((np.arange(900), far))[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(s - far[v]) < 1e-12 for _, v, s in got)
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        hits, total = hits + len({v for _, v, _ in got} & set(order.tolist())), total + 10
    assert hits / total >= 0.9
    ids = {r["vec_id"] for r in out} | {r["query_id"] for r in out}
    assert not ids & {900, 901, 902, 903, 904, 905, None}
    few = df.filter("vec_id < 3")
    assert rpforest.nearest(few, few, k=10).count() == 6 and rpforest.nearest(df.limit(0), df.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------------------------------

def test_classifier_learns_from_positives_and_unlabelled(spark, hard, nothing):
    good, bad = prose(300, 5), [" | ".join(t.split()) + " ###" for t in prose(300, 6)]
    texts = [t for pair in zip(good, bad) for t in pair]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(0, 600)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] + 1) % 2 for r in held]) > 0.9
    # labels of the held-out fold change nothing
    other = labels.withColumn("quality", F.when(quality.train_fold(), F.col("quality")).otherwise(0))
    assert sorted(map(str, quality.classify(docs, other).collect())) == sorted(map(str, out))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"]}


def test_classifier_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(hard, labels).count() == len(HARD) + 2
    assert quality.classify(nothing, labels).count() == 0
    assert {round(r["score"], 6) for r in quality.classify(hard, labels.limit(0)).collect()} == {0.5}


def test_classifier_with_one_long_blank_and_one_long_word(spark):
    docs = frame(spark, prose(60, 8) + ["\n" * 100_000, "x" * 1_000_000])
    labels = spark.createDataFrame([(i, int(i % 2 or i > 59)) for i in range(62)], "doc_id long, quality int")
    fitted = quality.train(docs.select("doc_id", "text"), labels)
    assert np.isfinite(fitted.weights).all() and np.isfinite(fitted.scale).all() and np.isfinite(fitted.bias)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs.select("doc_id", "text"), fitted).collect())


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_needs_no_negative_labels(prior):
    rng = np.random.default_rng(4)
    both = [rng.normal(0, 1, (n, 20)) for n in (1500, 4000)]
    both[0][:, 0] += 6
    truly = rng.random(4000) < prior
    both[1][truly, 0] += 6
    assert quality.estimate_prior(*both) == pytest.approx(truly.mean(), abs=0.03)
    assert quality.estimate_prior(both[0][:3], both[1]) == 0.5


def test_features_count_the_whole_text():
    texts = ["", "ab ab cd\n", "x" * 5000 + "|"]
    rows = quality.features(pa.array(texts))
    assert rows.shape == (3, quality.N_FEATURES) and np.isfinite(rows).all()
    assert rows[2, ord("|")] == pytest.approx(math.sqrt(1 / 5001)) and rows[1, ord("a")] == pytest.approx(math.sqrt(2 / 9))
    assert rows[1, -6] == pytest.approx(2 / 3) and rows[1, -5] == pytest.approx(1 / 3)


def test_fits_hold_their_rows_about_once():
    import tracemalloc
    rng = np.random.default_rng(3)
    one, two = (rng.random((n, quality.N_FEATURES), dtype=np.float32) for n in (500, 1000))
    kept = one.copy(), two.copy()
    for call in (lambda: quality.fit(one, two, 0.5, steps=3), lambda: quality.estimate_prior(one, two)):
        tracemalloc.start()
        call()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # the driver does this beside its JVM
        assert most < 2 * (one.nbytes + two.nbytes)
    assert (one == kept[0]).all() and (two == kept[1]).all()
