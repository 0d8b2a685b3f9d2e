"""Word-first backoff against a plain walk over words and n-grams."""

import math
import random
from collections import Counter

import pytest

from docframe.llm import language_id


def words_of(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def grams_of(word, order):
    marked = "^" + word + "^"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def plain_model(rows):
    counts = {}
    for text, lang in rows:
        counts.setdefault((lang, 0), Counter()).update(words_of(text))
    for lang in sorted({lang for _, lang in rows}):
        for order in (4, 3, 2, 1):
            counts[lang, order] = Counter(g for w in counts[lang, 0] for g in grams_of(w, order))
    return counts


def plain_predict(counts, text):
    langs = sorted({lang for lang, _ in counts})

    def kept(lang, order, x):
        return counts[lang, order][x] >= (2 if order == 0 else 1)

    def log(lang, order, x):
        own = counts[lang, order]
        n = own[x] if kept(lang, order, x) else 0
        return math.log((n + 0.5) / (sum(own.values()) + 0.5 * len(own) + 1))

    total = dict.fromkeys(langs, 0.0)
    for w in words_of(text):
        for order in (0, 4, 3, 2, 1):
            found = [x for x in ([w] if order == 0 else grams_of(w, order)) if any(kept(lang, order, x) for lang in langs)]
            if found:
                for lang in langs:
                    total[lang] += sum(log(lang, order, x) for x in found) / len(found)
                break
    if not words_of(text):
        return "und", 0.0
    best = max(langs, key=lambda lang: (total[lang], -langs.index(lang)))
    return best, 1 / sum(math.exp(total[lang] - total[best]) for lang in langs)


def test_backoff_equals_a_plain_walk(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdeé", "bb": "cdefgñ", "cc": "efghiß"}
    made = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7)))
    stock = {lang: [made(lang) for _ in range(30)] for lang in letters}
    rows = [(" ".join(rng.choice(stock[lang] + [made(lang)]) for _ in range(12)) + ", 7!", lang) for lang in letters for _ in range(15)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    counts = plain_model(rows)
    # Known words, unseen words of known letters, words of unknown letters, mixed scripts and texts without letters.
    asked = [" ".join(rng.choice(stock[rng.choice("abc") * 2]) for _ in range(3)) for _ in range(30)]
    asked += [made(rng.choice("abc") * 2) for _ in range(60)] + ["zzzz", "xaby", "Ab-CD 12", "", "12 !", "яблоко", "É É", "e"]
    for text, (lang, score) in zip(asked, model.predict(asked), strict=True):
        want = plain_predict(counts, text)
        assert score == pytest.approx(want[1], abs=1e-4), text
        assert lang == want[0] or want[1] < 0.5001, text
