"""The operators' plain functions against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

from corpuswatch.llm import line_dedup, lm_scoring, quality, segmentation, simhash, token_counts, topk, warc

ODD = ["", " ", "a", "Hello, World's 123 don't!", "İstanbul ΣΑΣ ς ß Ǆ", "<|endoftext|>a<|startoftext|> b <|endoftext|", " x y\x1cz\x85w　", "é ﬁ ﷺ 漢字 🙂👍🏽 ½ ²", "x" * 3000, "a\x00b\x07", "'s't're'LL", "|||&&&*** %%%foo%%%"]


def random_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    parts = ["the", "The", "tion", "ouble", "é", "ß", " ", "  ", "\n", ".", ", ", "'s", "'LL", "12", "&&&", "<|endoftext|>", "漢", "🙂", "\t", "Σ", "İ", " ", "ha", "wh", " ", "é"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = tokenizers.Tokenizer.from_file(path), token_counts.Counter(path)
    for text in [*ODD, *random_texts(500)]:
        assert ours(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def fingerprint_brute(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_equal_brute_force():
    for text in [*ODD, *random_texts(100), "one two", "one two three", " ".join(map(str, range(500)))]:
        assert simhash.fingerprint(text) == fingerprint_brute(text), repr(text)


def test_fingerprint_of_a_very_long_text_is_counted_in_steps(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 64)
    assert simhash.fingerprint(text) == whole == fingerprint_brute(text)


def test_features_of_empty_and_odd_texts_are_finite():
    for text in ODD:
        x = quality.features(text)
        assert x.shape == (len(quality.FEATURES),) and np.isfinite(x).all()


def test_gam_learns_an_interaction_and_scores_by_its_tables():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=50, pairs=2)
    accuracy = ((model.score(x[3000:]) > 0.5) == y[3000:]).mean()
    assert accuracy > 0.93
    plain = quality.fit(x[:3000], y[:3000], rounds=50, pairs=0)
    assert accuracy > ((plain.score(x[3000:]) > 0.5) == y[3000:]).mean() + 0.1


def test_gam_without_rows_or_with_one_label_is_constant():
    none = quality.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = quality.fit(np.ones((5, 3)), np.ones(5))
    assert (one.score(np.zeros((2, 3))) > 0.8).all()


def test_warc_record_round_trip():
    for revisit in (False, True):
        payload = "é\r\n\r\nx".encode()
        sha1 = warc.digest(payload)
        found = warc.parse(warc.record(7, "http://x/ a\r\nb", payload, sha1, 9 if revisit else None, revisit, "2024-01-01T00:00:00Z"))
        assert (found["page_id"], found["payload_bytes"], found["payload_digest"]) == (7, len(payload), sha1)
        assert found["record_type"] == ("revisit" if revisit else "response") and found["refers_to"] == (9 if revisit else None)
        assert found["payload"] == (None if revisit else payload) and found["url"] == "http://x/%20a%0D%0Ab"


def test_warc_refuses_a_changed_payload():
    data = warc.record(1, "u", b"abc", warc.digest(b"abd"), None, False, "d")
    with pytest.raises(ValueError, match="another payload"):
        warc.parse(data)


def test_ranges_coalesce_near_records_and_respect_the_block():
    wanted = [(0, 10), (10, 5), (100, 5), (104, 6), (5000, 50)]
    assert list(warc.ranges(wanted, gap=100, block=1000)) == [(0, 110, wanted[:4]), (5000, 50, wanted[4:])]
    assert [r[:2] for r in warc.ranges(wanted, gap=0, block=12)] == [(0, 10), (10, 5), (100, 10), (5000, 50)]
    assert list(warc.ranges([])) == []


def test_quantised_matrix_skips_bad_vectors():
    column = pa.array([[0.5, -0.001], None, [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [0.25], []], pa.list_(pa.float32()))
    m, good = topk._matrix(column)
    assert good.tolist() == [True, False, False, False, False, True, True]
    assert m[good].tolist() == [[128.0, -1.0], [64.0, 0.0], [0.0, 0.0]]


def test_chunks_depend_on_their_lines_alone():
    r = random.Random(3)
    lines = [f"line {r.random()}" for _ in range(60)]
    for mean in (1, 3):
        keys = {(tuple(lines[a : a + n]), key) for a, n, key in line_dedup.chunks(lines, mean=mean)}
        moved = [f"other {i}" for i in range(3)] + lines + ["end"]
        after = {(tuple(moved[a : a + n]), key) for a, n, key in line_dedup.chunks(moved, mean=mean)}
        assert keys <= after and len(after) <= len(keys) + 4
        assert len(keys) == 59 if mean == 1 else 8 < len(keys) < 35
    assert list(line_dedup.chunks([""])) == [] and [x[:2] for x in line_dedup.chunks(["w " * 51])] == [(0, 1)]
    assert {x[:2] for x in line_dedup.chunks(lines, span=3)} == {(i, 3) for i in range(58)}


def vocab() -> segmentation.Vocabulary:
    return segmentation.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)


def all_paths(text: str, v: segmentation.Vocabulary) -> dict[tuple[int, ...], float]:
    """Every segmentation of a short text with its probability."""
    weight = {v.text[i]: w for i, w in zip(v.ids.tolist(), v.weights.tolist(), strict=True)}
    number = {v.text[i]: i for i in v.ids.tolist()}
    s, out = "▁" + text.replace(" ", "▁"), {}

    def go(at: int, ids: tuple[int, ...], log_w: float) -> None:
        if at == len(s):
            out[ids] = log_w
            return
        for n in range(1, v.longest + 1):
            piece = s[at : at + n]
            if len(piece) == n and piece in weight:
                go(at + n, (*ids, number[piece]), log_w + weight[piece])
        if s[at] not in weight:
            own = v.encoded(s[at])
            go(at + 1, (*ids, *own), log_w + v.byte_weight * len(own))

    go(0, (), 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: x - total for k, x in out.items()}


def test_segmentations_are_distinct_decode_and_have_their_log_probabilities():
    v = vocab()
    for text in ["the ouble", "a", " x  y", "hé\n漢ก", "thth"]:
        truth = all_paths(text, v)
        got = segmentation.segment([text], [5], 4, v)[0]
        assert len(got) == min(4, len(truth)) and len({tuple(g[0]) for g in got}) == len(got)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        for ids, log_p, _, inclusion in got:
            assert math.isclose(truth[tuple(ids.tolist())], log_p, rel_tol=1e-6, abs_tol=1e-9) and v.decode(ids.tolist()) == text and 0 <= inclusion <= 1


def test_samples_follow_the_distribution_without_replacement():
    v, text, n = vocab(), "thea", 6000
    truth = all_paths(text, v)
    drawn = segmentation.segment([text] * n, list(range(n)), 2, v)
    first, second = {}, {}
    for a, b in drawn:
        first[tuple(a[0])] = first.get(tuple(a[0]), 0) + 1
        second[tuple(b[0])] = second.get(tuple(b[0]), 0) + 1
    p = {k: math.exp(x) for k, x in truth.items()}
    for k, x in p.items():
        then = sum(p[j] * x / (1 - p[j]) for j in p if j != k)
        assert abs(first.get(k, 0) / n - x) < 5 * math.sqrt(x * (1 - x) / n) + 1e-3
        assert abs(second.get(k, 0) / n - then) < 5 * math.sqrt(then * (1 - then) / n) + 1e-3
    # Horvitz-Thompson: each path's probability over its inclusion score adds up to one on average
    weights = [sum(math.exp(lp) / q for _, lp, _, q in rows) for rows in drawn]
    assert abs(np.mean(weights) - 1) < 0.05


def test_segmentations_depend_on_the_row_alone():
    v, texts = vocab(), random_texts(30, 9)
    together = segmentation.segment(texts, list(range(30)), 2, v)
    alone = [segmentation.segment([t], [i], 2, v)[0] for i, t in enumerate(texts)]
    assert [[r[0].tolist() for r in x] for x in together] == [[r[0].tolist() for r in x] for x in alone]
    for text, rows in zip(texts, together, strict=True):
        assert all(v.decode(r[0].tolist()) == text for r in rows)


def test_decoding_equals_the_library():
    v, library = vocab(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in [*ODD, *random_texts(50)]:
        assert v.decode(library.encode(text)) == text
    r, n = random.Random(6), library.get_piece_size()
    for _ in range(3000):  # controls, the unknown piece, single bytes, any piece
        ids = [r.choice([0, 1, 2, r.randrange(300), r.randrange(n)]) for _ in range(r.randrange(6))]
        assert v.decode(ids) == library.decode(ids)


def test_counts_equal_the_library_for_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = tokenizers.Tokenizer.from_file(path), token_counts.Counter(path)
    points = [c for c in [*range(0x33500), *range(0x3D800, 0x3DA00), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [f"a{chr(c)}b" for c in points[at : at + 4096]]
        want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
        assert [mine(t) for t in texts] == want


def test_packed_keys_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm_scoring.unpack(lm_scoring.pack(keys)) == keys).all()
    assert len(lm_scoring.unpack(lm_scoring.pack(keys[:0]))) == 0


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(2)
    true = np.array([0.6, 0.3, 0.1])
    # three kinds of tokens, each far likelier under one estimate; mixture weights are then their shares
    p = np.where(np.eye(3, dtype=bool), 0.5, 1e-6)
    n = rng.multinomial(100_000, true).astype(float)
    got = lm_scoring.learn_weights(np.array([3, 3, 3]), p, n)
    assert np.abs(got[3] - n / n.sum()).max() < 0.01
    assert np.abs(got[10] - got[3]).max() == 0 and abs(got.sum(axis=1) - 1).max() < 1e-9


def test_held_out_tokens_are_tabled_in_steps():
    word, pair, context = np.array([3, 1, 0, 3]), np.array([2, 0, 0, 2]), np.array([4, 5, 0, 4])
    keys, times = lm_scoring.held_out_keys(word, pair, context)
    places = lm_scoring.PLACES
    found = {(int(k) // places**2, int(k) // places % places, int(k) % places): int(t) for k, t in zip(keys, times, strict=True)}
    steps = lambda x: 1 + round(math.log(x) / lm_scoring.STEP)
    assert found == {(3, steps(4 / 2), steps(3)): 2, (3, 0, steps(1)): 1, (0, 0, 0): 1}


def test_fine_buckets_cover_their_coarse_one():
    starts = [x for c in range(5) for x in lm_scoring.fine_starts(c, 5, 3)]
    assert starts == sorted(set(starts)) and starts[0] == 0 and lm_scoring.fine_starts(4, 5, 3)[0] == 4 * ((1 << 64) // 5)


def test_levels_are_powers_of_two():
    assert lm_scoring.level(np.array([0.0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]


def test_merging_pops_the_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert token_counts.merges(list("abc"), ranks) == 2
    assert token_counts.merges(list("ab"), ranks) == 1 and token_counts.merges(list("ca"), ranks) == 0
    for size in range(1, 7):
        for word in itertools.product("abc", repeat=size):
            symbols, steps = list(word), 0
            while pairs := [(ranks[p], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in ranks]:
                _, i = min(pairs)
                symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
                steps += 1
            assert token_counts.merges(list(word), ranks) == steps
