"""The token files' encoder: whole texts' ids, with ASCII parts past the normalizer."""

import random

import numpy as np
import pyarrow as pa

from attestra.llm import tokenfiles


def test_ascii_parts_need_no_normalizer():
    with open(tokenfiles.vocabulary_path(), "rb") as f:
        encoder = tokenfiles.Encoder(f.read())
    whole, asked = encoder.tokenizer, []
    normal = encoder.normal
    encoder.normal = lambda text: asked.append(text) or normal(text)
    texts = ["The river, the RIVER\tand  stone's 12345", "", "\x1c a\x1fb \x00 <x>", "river " * 50 + "wood" * 40]
    for _ in range(2):  # then from what is known
        for got, text in zip(encoder.encode([t.encode() for t in texts]), texts, strict=True):
            assert np.frombuffer(got, f"<u{encoder.width}").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert not asked
    mixed = ["Fluß STRASSE river", "e\u0301 \u00a0x\u2003y \u0130I", None, "<|endoftext|> a<|startoftext|>b"]
    for got, text in zip(encoder.encode([t and t.encode() for t in mixed]), mixed, strict=True):
        assert np.frombuffer(got, f"<u{encoder.width}").tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert any("fluß" in t or "Fluß" in t for t in asked)


def test_a_part_is_looked_up_once_however_often_it_occurs():
    with open(tokenfiles.vocabulary_path(), "rb") as f:
        encoder = tokenfiles.Encoder(f.read())
    asked = []

    class Known(dict):
        def __getitem__(self, part):
            asked.append(part)
            return super().__getitem__(part)

        def get(self, part, *other):
            asked.append(part)
            return super().get(part, *other)

    encoder.known = Known(encoder.known)
    texts = [" river wood\n" * 200, "\t\x0b\x0c\r", None, "", "River \x1cwood\x85 \u00a0river", "x" * 100 + " river"]
    for _ in range(2):
        for got, text in zip(encoder.encode([None if t is None else t.encode() for t in texts]), texts, strict=True):
            assert np.frombuffer(got, f"<u{encoder.width}").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(asked) <= 2 * 8 and not any(len(p) > tokenfiles.LONGEST for p in encoder.known)


def test_a_word_is_encoded_apart_from_its_marks_and_gives_the_ids_of_the_whole():
    with open(tokenfiles.vocabulary_path(), "rb") as f:
        encoder = tokenfiles.Encoder(f.read())
    whole, together, asked = encoder.tokenizer, encoder._together, []
    encoder._together = lambda some: asked.extend(some) or together(some)
    encoder.encode([b"wood", b"Wood, WOOD. (wood) wood!!! wood\n", b"", None])
    assert asked.count(b"wood") == 1 and not any(p.startswith(b"wood") and p != b"wood" for p in asked)
    assert encoder.encode([]) == []
    draw = random.Random(11)
    odd = [*"abSTz019 .,'!_-=`^<|>#\t\n\x1c\x00", *"'s", *"'LL", "it's", "\u0301", "\u0338", "\u00e9", "\u00df", "\u0130", "\u03a3", "\u2026", "\u00a0", "\u0663", "\u4e2d"]
    texts = ["".join(draw.choices(odd, k=draw.randrange(40))) for _ in range(3000)]
    added = ["a.<|endoftext|>b.", "<|ENDOFTEXT|>.", "x<|startoftext|>, it's."]
    for some in (texts, added, texts[:50] + added):
        column = pa.array([b"before", *(t.encode() for t in some)], pa.binary())[1:]
        for got, text in zip(encoder.encode_column(column).to_pylist(), some, strict=True):
            assert np.frombuffer(got, f"<u{encoder.width}").tolist() == whole.encode(text, add_special_tokens=False).ids, text
