"""Packing, token files and pieces against the libraries, row by row."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odd_rows import ODD
from warden.llm import packing, pieces, token_files
from warden.llm.queries import tokenizer_file
from warden.llm.tokens import WordCachedTokenizer, tokenizer

WORD, BYTE, PIECE = (tokenizer_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXT = st.text(alphabet=st.sampled_from(list("ab \n\t'.,1é́ß日Σ ▁\x1c<|>")), max_size=40)


def whole(path, text):
    return tokenizer(path).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_word_cache_equals_whole_texts(path, texts):
    got = [np.frombuffer(b, "<u2").tolist() for b in tokenizer(path).encode_bytes(texts)]
    assert got == [whole(path, t) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_met_again_outlast_a_full_cache(path, monkeypatch):
    monkeypatch.setattr("warden.llm.tokens.CACHE_WORDS", 20)
    tok, encoded = WordCachedTokenizer(path), []
    plain, draw = tok._word, random.Random(3)
    monkeypatch.setattr(tok, "_word", lambda word: encoded.append(word) or plain(word))
    for _ in range(30):
        rare = ["".join(draw.choices("abcdeé", k=9)) for _ in range(6)]
        marked = [w + "".join(draw.choices("!$%&*#-_.,;'`~<|>", k=3)) for w in rare[:3]]
        text = " ".join(["The", "often", "often,", *rare, *marked, "often", "don't", "x\ny", "7%%"])
        assert [np.frombuffer(b, "<u2").tolist() for b in tok.encode_bytes([text])] == [whole(path, text)]
    assert encoded.count("often") == 1 and len(tok.words) + len(tok.older) < 80


def test_packing_places_every_piece(documents):
    rows = documents(ODD)
    got = packing.pack(rows, WORD, capacity=64).collect()
    want = []
    for doc, text in ODD:
        ids = np.array([*whole(WORD, text or ""), 0], "<u4")
        want += [(doc, i, a, len(p := ids[a : a + 64]), zlib.crc32(p.tobytes())) for i, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
    tokens = sum(w[3] for w in want)
    assert len(places) <= -(-tokens // 64) + 2
    assert packing.pack(rows.limit(0), WORD).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), min_size=1, max_size=30), st.sampled_from(packing.SETTINGS))
def test_plan_uses_each_piece_once(histogram, setting):
    used, slots = packing.plan(histogram, 100, *setting)
    ranks, filled = {}, {}
    for s in slots:
        ranks.setdefault(s.length, []).extend(range(s.rank, s.rank + s.count))
        for q in range(s.first, s.first + s.count):
            filled.setdefault(q, []).append((s.offset, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert sorted(filled) == list(range(used))
    for own in filled.values():
        ends = [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 100


def test_configurations_reach_the_fractional_optimum():
    # 60 + 40 and 50 + 50 leave nothing: 100 of each pair up exactly.
    assert packing.plan({60: 100, 40: 100, 50: 200}, 100, 10, 4)[0] == 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_blocks_round_trip(ids, data):
    out = io.BytesIO()
    writer = token_files.Writer(out)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=5)))
    docs = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
    for i, own in enumerate(docs):
        writer.add(None if i == 1 else i, np.array(own, np.uint32))
    writer.close()
    reader = token_files.Reader(out, len(out.getvalue()))
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == [(None if i == 1 else i, d) for i, d in enumerate(docs)]
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert reader.ids(a, b).tolist() == ids[a:b]


def test_token_files_in_order(documents, spark):
    rows = documents(ODD)
    got = token_files.encode_and_read(rows, BYTE).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc, text in order:
        ids = np.array([*whole(BYTE, text or ""), 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.encode_and_read(rows.limit(0), BYTE).collect() == []


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_pieces_equal_the_library(texts):
    model, own = library(), pieces.encoder(PIECE)
    for text, (ids, begins, ends) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == model.encode(text) and own.decode(ids.tolist()) == model.decode(model.encode(text))
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data
        assert (begins[1:] == ends[:-1]).all()


def test_piece_digests(documents):
    model = library()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(documents(ODD), PIECE).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [(d, model.encode(t or "")) for d, t in ODD]
    assert got == {(d, len(i), sha(",".join(map(str, i))), sha(model.decode(i))) for d, i in ids}
    spans = pieces.encode(documents(ODD).limit(0), PIECE)
    assert spans.collect() == [] and spans.columns == ["doc_id", "ids", "begins", "ends"]


def compiled(entries):
    """A character map in the public format, its double array filled by trying offsets."""
    blob, at, values = b"", {}, {}
    for k, v in entries.items():
        values[k.encode()] = len(blob)
        blob += v.encode() + b"\0"
    units, used = {0: 0}, {0}

    def fill(node, prefix):
        keys = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        offset = next(o for o in range(1, 1 << 16) if all((node ^ o ^ b) not in used for b in keys + [0] * leaf))
        units[node] = units.get(node, 0) | (offset << 10) | (0x100 if leaf else 0)
        children = [(node ^ offset ^ b, b) for b in keys]
        for child, b in children:
            used.add(child)
            units[child] = b
        if leaf:
            used.add(node ^ offset)
            units[node ^ offset] = 0x80000000 | values[prefix]
        for child, b in children:
            fill(child, prefix + bytes([b]))

    fill(0, b"")
    trie = np.zeros((max(units) | 0xFF) + 1, "<u4")
    for i, u in units.items():
        trie[i] = u
    return np.array([trie.nbytes], "<u4").tobytes() + trie.tobytes() + blob


def test_character_map_takes_the_longest_prefix():
    entries = {"ab": "X", "abc": "long", "é": "e", "ñ": "", "　": " "}
    chars = pieces.CharacterMap(compiled(entries))
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c", "é", "ñ", "　", "d"]) for _ in range(rng.randrange(12)))
        out, origin, i = "", [], 0
        while i < len(text):
            k = next((k for k in sorted(entries, key=len, reverse=True) if text.startswith(k, i)), None)
            piece = entries[k] if k else text[i]
            start = len(text[:i].encode())
            origin += [start] * len(piece.encode()) if k else list(range(start, start + len(piece.encode())))
            out += piece
            i += len(k) if k else 1
        got, where = chars.apply(text.encode())
        assert got.tobytes().decode() == out and where.tolist() == origin


def test_spaces_are_squeezed_and_projected():
    model = object.__new__(pieces.OffsetEncoder)
    model.map, model.kept = pieces.CharacterMap(compiled({"　": " "})), None
    model.dummy, model.squeeze, model.suffix, model.mark = True, True, False, "▁"
    text, origin = model.normalise("  a 　 b  ")
    assert text == "▁a▁b"
    assert origin.tolist() == [2, 2, 2, 2, 3, 3, 3, 8, 9]
    assert model.normalise("   ")[0] == ""
