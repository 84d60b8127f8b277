"""Each operator against a plain recomputation on small random inputs, without Spark."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tideline.llm import ann, bpe, decontaminate, near_dedup, ngram_lm, quality, secrets, token_counts, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if c < "\x7f" else c for c in text)


def windows_by_scan(texts, items, width):
    owners = {}
    for k, t in enumerate(items):
        w = WORD.findall(lowered(t))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            owners.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for t in texts:
        w = WORD.findall(lowered(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in owners}:
            for i in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[i : i + n]))) is not None:
                    found |= own
                    hit[i : i + n] = [True] * n
        out.append((len(w), hit, sorted(found)))
    return out


def test_backward_search_finds_every_window():
    rng = random.Random(5)
    for _ in range(120):
        letters, width = rng.choice("a ab abc abcdef".split()), rng.choice([1, 2, 3, 5, 10])
        make = lambda most: " ".join(rng.choice(letters + "xY") for _ in range(rng.randint(0, most)))
        texts, items = [make(60) for _ in range(rng.randint(1, 6))], [make(12) for _ in range(rng.randint(0, 4))]
        wanted = decontaminate.phrases([(k, t.encode()) for k, t in enumerate(items)], width)
        lengths, n_hit, found, hit, owner = decontaminate.hits([t.encode() for t in texts], wanted)
        spans, count = decontaminate.spans_of(hit, owner, lengths)
        at = 0
        for k, (n, flags, own) in enumerate(windows_by_scan(texts, items, width)):
            assert (lengths[k], n_hit[k], found[k].tolist()) == (n, sum(flags), own)
            covered = [False] * n
            for a, b in spans[2 * at : 2 * (at + count[k])].reshape(-1, 2):
                covered[a:b] = [True] * (b - a)
            at += count[k]
            assert covered == flags


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 500)
    tree = decontaminate.WaveletMatrix(values, 6)
    symbol, low = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    a, _ = tree.rank(symbol, low, low)
    assert a.tolist() == [int((values[:x] == s).sum()) for s, x in zip(symbol, low)]
    s, r = tree.symbol_and_rank(np.arange(500))
    assert (s == values).all() and r.tolist() == [int((values[:k] == values[k]).sum()) for k in range(500)]


def superminhash_one_by_one(values, m):
    """The signature with one permutation after another, as the definition says."""
    best = [None] * m
    for v in values:
        perm = list(range(m))
        for j in range(m):
            state = int(near_dedup.scramble(np.array([v], np.uint64), j + 1)[0])
            at = j + ((state & 0xFFFFFFFF) * (m - j) >> 32)
            perm[j], perm[at] = perm[at], perm[j]
            rank = (j << 32) + (state >> 32)
            if best[perm[j]] is None or rank < best[perm[j]]:
                best[perm[j]] = rank
    return best


def test_superminhash_equals_its_definition():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    got = near_dedup.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 32)
    for row, s in zip(got.tolist(), sets):
        assert row == superminhash_one_by_one(s.tolist(), 32)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [base[:300], base[100:]]
    sig = near_dedup.signatures(np.concatenate(sets), np.array([300, 300]), 160)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15


def test_shingle_sets():
    assert len(near_dedup.shingle_set(b"", 2)) == 0 and len(near_dedup.shingle_set(b" \n", 2)) == 0
    assert near_dedup.shingle_set(b"One", 2).tolist() == near_dedup.shingle_set(b"oNE ", 2).tolist() != near_dedup.shingle_set(b"two", 2).tolist()
    assert len(near_dedup.shingle_set(b"a b a b a", 2)) == 2


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(vocabulary):
    rng = random.Random(6)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " \t", "Hello  wörld's <|endoftext|>x 12ab\n\té", "<|startoftext|><|endoftext|", "ΑΣ ΣΑΣ. İſ 1²Ⅷ", "x" * 3000, "they'LL 's''t a\x1cb\x85c d", "é ́e", "日本語テキスト"]
    texts += ["".join(rng.choice(["th", "e", "ing", " ", "é", "1", "'", ".", "Ü", "日"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["".join(rng.choice("abcde") for _ in range(bpe.LONG + 500))]
    ids = bpe.encoder(vocabulary)([t.encode() for t in texts])
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]
        assert bpe.decoded(vocabulary, x) == library.decode(x.tolist(), skip_special_tokens=False)


def test_long_and_short_words_merge_alike(vocabulary):
    words = [b"internationalisation", b"aaaaaaaaaaaaaaaa", bytes(range(60, 120))]
    assert [bpe.scan_words(vocabulary, [w])[0] for w in words] == [bpe.heap_word(vocabulary, w) for w in words]


def test_trigram_queries_are_mandatory():
    samples = {"assign": ["password = 'abcdefghijkl'", 'API_KEY:"ABCdef123456"', "apiKey=x"], "access": ["AKIAABC"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"],
               "github": ["ghp_" + "a" * 36], "slack": ["xoxb-1234567890"], "google": ["AIza" + "x" * 35], "jwt": ["eyJ" + ".".join(["a" * 10] * 3)]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text)
            assert all(any(all(g in text.lower() for g in option) for option in clause) for clause in query)


def test_tokens_go_to_sections_by_the_rule():
    rng = random.Random(2)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encode, sizes = token_counts.encoding(f.read(), public_tokenizers.PATTERN)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the ", "\n", "\n\n", "  ", "é", "日本", "\r\n", " x"]) for _ in range(rng.randint(0, 30)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ends, cuts = np.cumsum(sizes[np.array(encode.encode_ordinary(text), np.int64)]), token_counts.line_ends(raw)
        assert not len(ends) or ends[-1] == len(raw)
        for rule in token_counts.RULES:
            counts, share, _ = token_counts.attributed(ends, cuts, rule)
            expected, begin = [0] * len(cuts), 0
            for end in ends:
                overlap = [max(0, min(c, end) - max(begin, cuts[k - 1] if k else 0)) for k, c in enumerate(cuts)]
                expected[overlap.index(max(overlap)) if rule == "majority" else next(k for k, v in enumerate(overlap) if v)] += 1
                begin = end
            assert counts.tolist() == expected and abs(share.sum() - len(ends)) < 1e-9


def test_bloom_levels_are_never_low():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.geometric(0.3, len(keys))
    level = ngram_lm.levels_of(counts)
    assert level.tolist() == [int(c).bit_length() for c in counts]
    size = 64 * (1 + int(level.sum()) * ngram_lm.BITS // 64)
    bits = np.zeros(size, bool)
    for k in range(1, level.max() + 1):
        for at in ngram_lm.positions(keys[level >= k], k, size):
            bits[at.astype(np.int64)] = True
    one = ngram_lm.Filter([(0, np.packbits(bits, bitorder="little").tobytes())], 2, 1)
    found = one.levels(keys, 0)
    assert (found >= level).all() and (found == level).mean() > 0.95
    other = np.setdiff1d(rng.integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert (one.levels(other, 0) > 0).mean() < 0.06
    assert (one.levels(keys, 1) == 0).all()
    assert ngram_lm.unpacked(ngram_lm.packed(keys)).tolist() == keys.tolist()


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(9)
    grade = rng.integers(0, 3, 900)
    texts = [b" ".join([b"common%d" % rng.integers(30) for _ in range(20)] + [b"bad"] * (g > 0) + [b"awful"] * (g > 1)) for g in grade.tolist()]
    ids, lengths = toxicity.features(texts)
    model = toxicity.fit(ids, lengths, grade, np.ones(900), 3)
    assert model.thresholds[0] < model.thresholds[1]
    p = model.at_least(*toxicity.features([b"common1 fine", b"common1 bad", b"common1 bad awful", b""]))
    assert (p[:, 0] >= p[:, 1]).all() and p.sum(1)[0] < p.sum(1)[1] < p.sum(1)[2]
    assert (p >= 0.5).sum(1).tolist()[:3] == [0, 1, 2]


def test_quality_features_and_fit():
    good, junk = b"The plain text of a page. It goes on.\nAnd on.", b"Buy | now | here | !!! %%% ###\n||| $$$ 12345"
    x = np.array([quality.features(good)] * 20 + [quality.features(junk)] * 20)
    w = quality.fit_logistic(x, np.repeat([1.0, 0.0], 20), np.ones(40))
    assert (x[:20] @ w > 0).all() and (x[20:] @ w < 0).all()
    assert not quality.features(b" \n").any()


def test_partitions_are_balanced_and_routing_reaches_neighbours():
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(8, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in centre])
    graph = ann.neighbours(ann.unit(x), x, 10, np.arange(len(x)))
    part = ann.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.1 * 100 + 1
    router = ann.fit_router(x, 6400, 10)
    assert router.weights.shape[1] == 8 and router.visits < 8


def test_visits_are_set_on_rows_kept_out_of_the_fit(monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 12))
    x, later = (centre[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, 12)) for n in (2000, 2000))
    fitted, asked = [], []
    graph, near = ann.balanced_parts, ann.neighbours
    monkeypatch.setattr(ann, "balanced_parts", lambda g, *a: fitted.append(len(g)) or graph(g, *a))
    monkeypatch.setattr(ann, "neighbours", lambda q, *a: asked.append(q) or near(q, *a))
    router = ann.fit_router(x, 8000, 20)
    rows = {tuple(v) for v in np.round(asked[0], 12)}
    check = np.round(ann.unit(asked[-1]), 12)
    assert fitted[0] + len(check) == len(x) and not any(tuple(v) in rows for v in check)
    # recall over several parts, of rows that the router has not seen, against brute force
    order, home = router.order(later), router.order(later)[:, 0]
    true = near(later, later, 20, np.arange(len(later)))
    met = [(np.isin(home[t], order[i, : router.visits])).mean() for i, t in enumerate(true)]
    assert router.weights.shape[1] == 10 and np.mean(met) >= 0.9
