import numpy as np
import pyarrow as pa

from stellwerk.llm import piece_codec
from stellwerk.llm.registry import vocabulary


class Pieces:
    def __init__(self, pieces):
        self.matrix = np.zeros((len(pieces), max(map(len, pieces))), np.uint32)
        for row, piece in enumerate(pieces):
            self.matrix[row, : len(piece)] = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(p) for p in pieces])
        self.characters = np.zeros(0x110000, bool)
        self.characters[self.matrix] = True
        self.characters[0] = False


def test_occurrences_equal_plain_search():
    """Whatever the number of characters, and so the number of them that fit one comparison."""
    random = np.random.default_rng(7)
    for kinds in (2, 40, 3_000):
        text = "".join(chr(0x4E00 + k) for k in random.zipf(1.3, 4_000) % kinds)
        cut = [(int(at), int(n)) for at, n in zip(random.integers(0, 3_900, 300), random.integers(1, 17, 300))]
        pieces = sorted({text[at : at + n] for at, n in cut} | {"absent", text[:8] + "x", text[:3][::-1] * 5, text[-16:], text[-9:]})
        points = np.frombuffer((text + piece_codec._BREAK).encode("utf-32-le"), np.uint32)
        order, low, high = piece_codec.occurrences(Pieces(pieces), points)
        for piece, a, b in zip(pieces, low, high):
            assert sorted(order[a:b].tolist()) == [i for i in range(len(text)) if text.startswith(piece, i)]


def test_words_are_remembered_between_batches(monkeypatch):
    tools = piece_codec.Vocabulary(vocabulary("piece_bpe_32k.model"))
    encoder, texts = piece_codec.Encoder(tools), pa.array(["one two  three", None, "", "two 中\U0010ffff", "one"])
    first = [x.tolist() for x in encoder.batch(texts)]
    monkeypatch.setattr(piece_codec, "encode_points", None)
    assert [x.tolist() for x in encoder.batch(texts)] == first
    monkeypatch.undo()
    monkeypatch.setattr(piece_codec, "REMEMBERED", 0)
    assert [x.tolist() for x in encoder.batch(texts)] == first
