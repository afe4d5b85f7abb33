"""Cleaning against character-by-character models, on random texts."""

import random

import pytest

from termindex.functions import text as tx


def skip_body(t, j, stops):
    """Position of the first unescaped stop character, or of where the text gives out."""
    while j < len(t) and t[j] not in stops:
        if t[j] == "\\":
            if j + 1 == len(t):
                break
            j += 1
        j += 1
    return j


def model_clike(t):
    out, i = [], 0
    while i < len(t):
        if t[i] == '"':
            j = skip_body(t, i + 1, '"\n')
            i = j + 1 if t[j:j + 1] == '"' else j
            continue
        if t[i] == "'":
            j = skip_body(t, i + 1, "'")
            if t[j:j + 1] == "'":
                i = j + 1
                continue
        elif t.startswith("//", i):
            i = skip_body(t, i + 2, "\n")
            continue
        elif t.startswith("/*", i):
            end = t.find("*/", i + 2)
            if end >= 0:
                i = end + 2
                continue
        out.append(t[i])
        i += 1
    return "".join(out)


def model_python(t):
    out, i = [], 0
    while i < len(t):
        quote = t[i]
        if quote in "\"'":
            if t.startswith(quote * 3, i):
                end = t.find(quote * 3, i + 3)
                if end >= 0:
                    i = end + 3
                    continue
            j = skip_body(t, i + 1, quote + "\n")
            if t[j:j + 1] == quote:
                i = j + 1
                continue
        elif quote == "#":
            end = t.find("\n", i)
            i = len(t) if end < 0 else end
            continue
        out.append(t[i])
        i += 1
    return "".join(out)


def model_squeeze(t):
    out = [" "]
    blank = 0
    for ch in t:
        if ch in " \t":
            if out[-1] == "\n" or blank:
                continue
            blank = 1
        elif ch == "\n":
            blank = 0
            if out[-1] == "\n":
                continue
        else:
            blank = 0
        out.append(ch)
    return "".join(out[1:])


@pytest.mark.parametrize("alphabet,expression,model", [
    ("ab/*\"'\\\n ", tx.strip_clike, model_clike),
    ("/*\"", tx.strip_clike, model_clike),
    ("'\\/\n", tx.strip_clike, model_clike),
    ("ab#\"'\\\n ", tx.strip_python, model_python),
    ("\"'\n", tx.strip_python, model_python),
    ("\"#a", tx.strip_python, model_python),
    ("ab \t\n", tx.squeeze_blank, model_squeeze),
])
def test_random_texts(spark, alphabet, expression, model):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 24))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", expression("t").alias("o")).collect()
    wrong = [(texts[r["i"]], r["o"], model(texts[r["i"]])) for r in got if r["o"] != model(texts[r["i"]])]
    assert wrong[:5] == []
