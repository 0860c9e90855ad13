"""op4, op5, op6: encoding against the library, packing and files against brute force."""
import random
import zlib

import numpy as np
import pytest

from greenscan.llm import packing, pieces, token_files
from greenscan.llm.common import shared_folder
from greenscan.llm.tokenizing import WordEncoder, vocabulary


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_whole_text_encoding(name, odd_rows):
    enc = WordEncoder(vocabulary(name), max_words=50, max_lines=5)  # emptied all the time
    rng = random.Random(5)
    parts = list("ab  \n\t.,'s'll0123éßİñ́\x85\xa0\x1c\r<|>漢字АЯ") + ["don't", "I'LL", "<|endoftext|>", " \n", "The", "the,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r[1] or "" for r in odd_rows]
    for text, want in zip(texts, enc.tok.encode_batch(texts, add_special_tokens=False)):
        assert enc.ids(text).tolist() == want.ids, text[:80]
    assert enc.ids(None).size == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together_equal_the_library(name, odd_rows):
    enc = WordEncoder(vocabulary(name), max_words=50, max_lines=5)
    rng = random.Random(8)
    parts = list("ab  \n.,'s0éßñ\x85\xa0\x1c漢Аª_!#") + [" it's", "\n's", " foo###", " été,", "\nÉA!!", "\n\xa0\xa0a", "\n\t\ta", " x.'", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["\xa0\xa0a b", "'s a", "the of\nthe of, the. " * 50 + "end"] + [r[1] or "" for r in odd_rows]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    got = [x for a in range(0, len(texts), 300) for x in enc.encode_many(texts[a:a + 300])]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == want
    assert enc.encode_many([None, "", "a"]) == [b"", b"", enc.encode("a")] and enc.encode_many([]) == []


def test_a_batch_looks_up_its_distinct_words_only():
    enc = WordEncoder(vocabulary("byte_bpe_50k.json"))
    asked = []
    numbers = enc._numbers
    enc._numbers = lambda words: asked.append(len(words)) or numbers(words)
    assert enc.encode_many(["the of and, the of\nthe"] * 500) == [enc.encode("the of and, the of\nthe")] * 500
    assert asked == [4]


@pytest.mark.parametrize("name, ids", [("byte_bpe_50k.json", [31373, 220, 50256, 995]),
                                       ("word_bpe_49k.json", [3306, 49407, 1002])])
def test_added_tokens_get_their_ids(name, ids):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(vocabulary(name)), WordEncoder(vocabulary(name))
    assert enc.ids("hello <|endoftext|> world").tolist() == ids
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "endoftext", "|>", " ", "\n", "  ", "\t", "The", "é", "漢", "İ", "'s", "7"]
    for text in ("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)):
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, odd_docs, odd_rows):
    path = vocabulary("byte_bpe_50k.json")
    tok = WordEncoder(path).tok
    folder = shared_folder(spark, "test-tokens")
    manifest = token_files.write_token_files(odd_docs, path, 0, folder)
    got = token_files.read_token_files(manifest, with_ids=True).collect()
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in odd_rows),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) \
        == sorted((str(i), len(x), crc(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, ids ascending, nulls first
        assert r["start"] == at and crc(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [i for i, _ in want]


def test_token_files_empty_table_and_damage(spark, no_docs, odd_docs, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    assert token_files.token_files(no_docs, path, 0).count() == 0
    m = token_files.write_token_files(odd_docs, path, 0, str(tmp_path / "t"))
    name = m.first()["path"]
    with open(name + ".bin", "ab") as f:
        f.write(b"xx")
    with pytest.raises(ValueError):
        token_files.open_tokens(name, 2)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = np.minimum(rng.geometric(1 / 60, 4000), capacity)
    hist = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.plan_sequences(hist, capacity)
    used = np.zeros(capacity + 1, int)
    for pattern, times in plan:
        assert sum(pattern) <= capacity and times > 0
        for v in pattern:
            used[v] += times
    assert (used == hist).all()
    assert sum(t for _, t in plan) <= -(-lengths.sum() // capacity) + 2


def test_fit_is_a_non_negative_least_squares_solution():
    patterns = np.array([[6, 2, 0], [5, 3, 0], [4, 4, 0], [4, 2, 2], [8, 0, 0]])
    hist = np.array([0, 0, 9, 4, 13, 4, 5, 0, 7])
    x = packing.fit_counts(patterns, hist, rounds=20_000)
    a = np.zeros((9, 5))
    for j, p in enumerate(patterns):
        for v in p[p > 0]:
            a[v, j] += 1
    grad = a.T @ (a @ x - hist)
    assert (x >= 0).all() and (np.abs(grad[x > 1e-3]) < 1e-2).all() and (grad > -1e-2).all()


def test_packing_places_every_piece(spark, odd_docs, odd_rows, no_docs):
    path = vocabulary("word_bpe_49k.json")
    tok = WordEncoder(path).tok
    capacity = 64
    got = packing.pack_documents(odd_docs, path, 1, capacity, with_ids=True).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, s, len(ids[s:s + capacity]), crc(ids[s:s + capacity]))
                 for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        assert crc(r["ids"]) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(places) <= -(-sum(w[3] for w in want) // capacity) + 1
    assert packing.pack_documents(no_docs, path).count() == 0


def test_sampled_pieces_are_lossless_and_reproducible(spark, odd_docs, odd_rows, no_docs):
    path = vocabulary("piece_bpe_32k.model")
    got = pieces.sample_pieces(odd_docs, path, with_ids=True).collect()
    assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in got) \
        == sorted((str(i), zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    model = pieces.PieceSampler(path, max_units=40)
    again = model.encode([t for _, t, *_ in odd_rows], np.array([i or 0 for i, *_ in odd_rows]))
    assert sorted((str(i), crc(x)) for (i, *_), x in zip(odd_rows, again)) \
        == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got)
    assert [model.decode(x) for x in again] == [t or "" for _, t, *_ in odd_rows]
    assert pieces.sample_pieces(no_docs, path).count() == 0


def test_samples_follow_the_lattice_distribution():
    model = pieces.PieceSampler(vocabulary("piece_bpe_32k.model"))
    s = pieces.SPACE + "reader"

    def walk(i):
        if i == len(s):
            yield (), 1.0
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in model.piece:
                k = model.piece[s[i:j]]
                for rest, w in walk(j):
                    yield (k, *rest), w * model.weight[k]

    weights = dict(walk(0))
    total, n = sum(weights.values()), 40_000
    drawn = {}
    for x in model.encode(["reader"] * n, np.arange(n)):
        drawn[tuple(x.tolist())] = drawn.get(tuple(x.tolist()), 0) + 1
    assert set(drawn) <= set(weights)
    assert sum(abs(w / total - drawn.get(k, 0) / n) for k, w in weights.items()) / 2 < 0.03


def test_lattice_edges_are_all_pieces_by_end_longest_first():
    model = pieces.PieceSampler(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    alphabet = list("abeinrst▁▁.,0é漢Я\x01") + [pieces.LITERAL, "𓀀", "the", "▁read"]
    units = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["𓀀"]
    for batch in (units, units[-1:]):  # the last one holds no piece at all
        joined = "\0".join(batch) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bare = np.array([i for i, c in enumerate(joined) if c != "\0" and c not in model.piece], dtype=np.int64)
        got = list(zip(*(x.tolist() for x in model._edges(chars, bare, np.full(len(bare), -7)))))
        want = [(a, b, model.piece.get(joined[a:b], -7)) for b in range(1, len(joined) + 1)
                for a in range(max(0, b - 40), b)
                if joined[a:b] in model.piece or (a + 1 == b and a in bare)]
        assert got == want


def test_steps_of_the_reversed_trie():
    model = pieces.PieceSampler(vocabulary("piece_bpe_32k.model"))
    by_end = {}
    for p in model.piece:
        for k in range(1, len(p) + 1):
            by_end.setdefault(p[-k:], None)

    def walk(s):
        node = 0
        for c in reversed(s):
            node = int(model._step(np.array([node << 21 | ord(c)]))[0])
        return node

    rng = random.Random(9)
    for s in rng.sample(sorted(by_end), 500):
        assert walk(s) > 0 and model.step_piece[walk(s)] == model.piece.get(s, -1)
        odd = "\x02" + s
        assert odd in by_end or model._step(np.array([walk(s) << 21 | 2]))[0] == 0


def test_known_units_are_kept_while_new_ones_fit():
    model = pieces.PieceSampler(vocabulary("piece_bpe_32k.model"), max_units=6)
    learned, learn = [], model._learn
    model._learn = lambda new: learned.append(sorted(new)) or learn(new)
    keys = np.arange(1)
    for text in ("a b c d", "a b c d e", "f g h"):
        assert model.decode(model.encode([text], keys)[0]) == text
    assert learned[1] == ["▁e"] and len(learned[2]) == 3 and len(model.unit) == 3
