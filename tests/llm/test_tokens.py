import numpy as np
import pyarrow as pa
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from barline.llm import tokens

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\xa0é€𝄞.", max_size=40)), max_size=12)


def spans(texts, limit):
    out = []
    for _, _, data, offsets in tokens.pieces(pa.array(texts, pa.string()), limit=limit):
        starts, ends, rows = tokens.word_spans(data, offsets)
        hashes = tokens.hash_spans(data, starts, ends)
        raw = data.tobytes()
        got = [[] for _ in range(len(offsets) - 1)]
        for s, e, r, h in zip(starts, ends, rows, hashes, strict=True):
            got[r].append((raw[s:e].decode(), int(h)))
        out += got
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_are_those_of_the_pattern(texts, limit):
    got = spans(texts, limit)
    assert [[w for w, _ in row] for row in got] == [words(t) for t in texts]
    flat = [x for row in got for x in row]
    assert len({w for w, _ in flat}) == len(set(flat)) == len({h for _, h in flat})


def test_hash_does_not_depend_on_segments(monkeypatch):
    text = " ".join(f"word{k}" for k in range(500))
    whole = spans([text], 1 << 20)
    monkeypatch.setattr(tokens, "SEGMENT", 16)
    assert spans([text], 1 << 20) == whole


def test_windows_stay_inside_a_text():
    hashes = np.arange(6, dtype=np.uint64)
    rows = np.array([0, 0, 0, 1, 1, 2])
    got, first = tokens.windows(hashes, rows, 2)
    assert first.tolist() == [0, 1, 3] and len(set(got.tolist())) == 3
    assert tokens.windows(hashes[:1], rows[:1], 2)[1].tolist() == []
