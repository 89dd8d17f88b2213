import random

import pytest

from weftline.llm import language_id as L


@pytest.mark.parametrize("n", [1, 23, 24, 25, 26, 45, 46, 47, 48, 10_000])
def test_pieces_hold_every_gram(n):
    r = random.Random(n)
    w = "".join(r.choice("abcdefghij") for _ in range(n))
    got = L.pieces(w)
    assert got[0] + "".join(x[2:] for x in got[1:]) == w and max(map(len, got)) <= L.REACH
    assert [x[i : i + 3] for x in got for i in range(len(x) - 2)] == [w[i : i + 3] for i in range(n - 2)]


def test_inner_letters_of_a_long_run_are_read():
    r = random.Random(3)
    run = lambda v, n: "".join(r.choice(v) for _ in range(n))
    text = lambda v: " ".join(run(v, 8) for _ in range(40))
    m = L.Model(["a", "b"], {})
    m.train([(L.chains(text("aeiou")), 0) for _ in range(60)] + [(L.chains(text("xyzwv")), 1) for _ in range(60)])
    assert m.predict([run("xyzwv", 12) + run("aeiou", 1000) + run("xyzwv", 12)])[0][0] == "a"
