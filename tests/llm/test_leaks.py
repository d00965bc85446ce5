"""Items held in long, repetitive documents, and where they stand."""

import random

from quire.llm.leaks import Scanner, tokens, words

ITEM = [f"w{k}" for k in range(100)]


def filler(n: int, tag: str) -> list[str]:
    return [f"{tag}{k}" for k in range(n)]


def test_repeated_part_hides_no_other():
    text = []
    for k in range(30):
        text += ITEM[:30] + filler(20, f"f{k}x")
    text += ITEM[40:65]
    assert [(i, s) for i, s, _, _ in Scanner({1: ITEM}, 0.5).scan(text)] == [(1, 0.55)]


def test_many_places_keep_the_run_whole():
    # the item begins 12 times with the same five words, so every such place opens 12 runs
    item = []
    for k in range(12):
        item += ["a", "b", "c", "d", "e", *filler(3, f"m{k}x")]
    got = Scanner({1: item}, 0.5).scan(filler(10, "f") + item + filler(10, "g"))
    assert got == [(1, 1.0, 10, 105)]


def test_best_pair_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(200):
        text = []
        for k in range(rng.randint(1, 12)):
            a = rng.randrange(90)
            text += ITEM[a : a + rng.randint(5, 40)] + filler(12, f"f{k}x")
        s = Scanner({1: ITEM}, 0.0)
        got = s.scan(text)
        runs, at = [], 0
        while at < len(text):
            if text[at] in ITEM:
                end = at
                while end < len(text) and text[end] in ITEM:
                    end += 1
                if end - at >= 5:
                    runs.append((ITEM.index(text[at]), ITEM.index(text[end - 1]) + 1))
                at = end
            at += 1
        want = max((len(set(range(*a)) | set(range(*b))) for a in runs for b in runs), default=0)
        assert (got[0][1] if got else 0) == want / 100


def test_offsets_through_normalisation():
    text = "x​y So­ft café ﬁne Рaper ＡＢ 가가 ｶﾞ 道德 İz end​."
    got = tokens(text)
    assert [w for w, _, _ in got] == words(text)
    assert [text[a:b] for w, a, b in got if w in ("soft", "café", "fine", "paper", "ab", "德", "end")] == ["So­ft", "café", "ﬁne", "Рaper", "ＡＢ", "德", "end​"]


def test_tokens_are_the_words_of_any_text():
    rng = random.Random(2)
    chars = "ab Z.,\n​­̧́̈éﬁﬀ①½РаοΣς İ가각각ｶﾞﾟ道⼀Ａ　 ẛ̣שׁक़ো"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 25)))
        got = tokens(text)
        assert [w for w, _, _ in got] == words(text)
        assert all(0 <= a < b <= len(text) for _, a, b in got)
