"""The run-length index against brute force."""

import random

import numpy as np

from lodestone.llm.runindex import NONE, RunLengthIndex, first_owners


def flat(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])


def some_strings(alphabet, n, low, high):
    return [bytes(random.choice(alphabet) for _ in range(random.randrange(low, high))) for _ in range(n)]


def test_matching_statistics_of_other_text():
    random.seed(21)
    for _ in range(40):
        alphabet = random.choice([b"ab", b"abc", b"abcdefgh"])
        indexed, streamed = some_strings(alphabet, 5, 1, 40), [*some_strings(alphabet, 5, 1, 40), b"zza", b"z"]
        lengths, places = RunLengthIndex(indexed, np.arange(5), 5, False).statistics(*flat(streamed))
        want = []
        for s in streamed:
            for i in range(len(s)):
                k = 0
                while i + k < len(s) and any(s[i : i + k + 1] in x for x in indexed):
                    k += 1
                want.append(k)
        assert lengths.tolist() == want
        whole, text = b"".join(streamed), b"\xff".join(indexed) + b"\xff"
        for i, (n, p) in enumerate(zip(lengths.tolist(), places.tolist(), strict=True)):
            assert not n or text[p : p + n] == whole[i : i + n]


def test_the_index_decides_about_text_that_is_not_in_it():
    shared = b"a passage of more than fifty bytes, which two documents hold, word by word"
    index = RunLengthIndex([b"first " + shared, b"something else of more than fifty bytes, that is nowhere else"], np.array([3, 4]), 50, True)
    streamed = b"xx " + shared + b" yy"
    got = index.owners_of(np.frombuffer(streamed, np.uint8), np.array([len(streamed)]))
    hits = [i for i in range(len(streamed)) if got[i] != NONE]
    assert hits == list(range(2, 3 + len(shared) - 50 + 1)) and set(got[hits]) == {3}


def test_first_owners_over_rounds():
    random.seed(22)
    for alphabet in (b"ab", b"abcdefgh"):
        strings = list(dict.fromkeys(some_strings(alphabet, 300, 6, 30)))
        owners = np.array([random.randrange(80) for _ in strings])
        found, begins, windows = first_owners(strings, owners, np.zeros(len(strings), np.int64), 6)
        least = {}
        for s, o in zip(strings, owners.tolist(), strict=True):
            for i in range(len(s) - 5):
                least[s[i : i + 6]] = min(least.get(s[i : i + 6], 99), o)
        assert found.tolist() == [least[s[i : i + 6]] for s in strings for i in range(len(s) - 5)]


def test_runs_are_few_in_repetitive_text():
    random.seed(23)
    base = bytes(random.choice(b"abcdefgh") for _ in range(200))
    copies = [base[i % 7 :] for i in range(60)]
    assert RunLengthIndex(copies, np.arange(60), 50, False).n_runs < 600
