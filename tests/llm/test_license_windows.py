"""Licence notices inside longer texts: wrapped, sharing a line, and against a plain search of all windows."""

import random
import re
import textwrap

from lithoframe.llm.license_scan import FULL_TEXTS, TEMPLATES, license_matches, template_bigrams

R = random.Random(11)
STOCK = {n: set(template_bigrams(t)) for n, t in TEMPLATES.items()}


def prose(n):
    return " ".join(R.choice(["alpha", "the", "of", "under", "beta", "license", "gamma", "version"]) for _ in range(n))


def dice(own, grams):
    return 2 * len(own & grams) / (len(own) + len(grams)) if own else 0.0


def plain(text, least=0.8):
    lines = [re.findall(r"[^\W_]+", x.lower()) for x in text.split("\n")]
    grams = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    words = [w for x in lines for w in x]
    line_of = [k for k, x in enumerate(lines) for _ in x]
    every, out = grams(words), []
    for name, t in STOCK.items():
        had = [k for k, x in enumerate(lines) if dice(set(grams(x)), t) >= least]
        out += [(name, dice(set(grams(lines[k])), t)) for k in had]
        if len(lines) > 1 and (d := dice(set(every), t)) >= least:
            out.append((name, d))
            continue
        best = []
        for i, g in enumerate(every):
            ends = [j for j in range(i, min(len(every), i + int(len(t) * (2 - least) / least + 1e-9))) if every[j] in t] if g in t else []
            if ends:
                w = min((-dice(set(every[i : j + 1]), t), j - i + 1, i) for j in ends)
                if -w[0] >= least and not set(line_of[i : i + w[1] + 1]) & set(had):
                    best.append(w)
        kept = []
        for w in sorted(best):
            if not any(k[2] <= w[2] + w[1] and w[2] <= k[2] + k[1] for k in kept):
                kept.append(w)
        out += [(name, -w[0]) for w in kept]
    return sorted((n, round(d, 9)) for n, d in out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: sorted((m.template, round(m.dice, 9)) for m in r.matches) for r in license_matches(df).collect()}


def test_wrapped_and_embedded_notices(spark):
    names = sorted(TEMPLATES)
    wrapped = [f"{prose(80)}\n# " + "\n# ".join(textwrap.wrap(TEMPLATES[n], 40, break_long_words=False)) + f"\n{prose(200)}" for n in names]
    embedded = [f"{prose(60)} {TEMPLATES[n]} {prose(60)}" for n in names]
    got = found(spark, [*wrapped, *embedded, "Released under the MIT License. Copyright 2020 Foo"])
    for k, n in enumerate(names * 2):
        assert (n, 1.0) in got[k], n
    assert got[2 * len(names)] == [("MIT", 1.0)]


def test_windows_equal_plain_search(spark):
    texts = ["", "word", "Released under the MIT License. " * 3, "Released under the MIT License.\n" * 3, "Released under\nthe MIT License.\n" * 3 + prose(90)]
    for _ in range(60):
        words = prose(R.randint(0, 60)).split()
        for t in R.choices(list(TEMPLATES.values()), k=R.randint(1, 3)):
            part = t.split()
            for _ in range(R.randint(0, 4)):
                part[R.randrange(len(part))] = R.choice(["alpha", "the", "license", "mit"])
            at = R.randint(0, len(words))
            words[at:at] = part
        texts.append("".join(w + R.choice("    \n") for w in words))
    got = found(spark, texts)
    assert [(k, t) for k, t in enumerate(texts) if got[k] != plain(t)] == []


def test_full_texts_under_a_copyright_line_and_above_code(spark):
    names = sorted(FULL_TEXTS)
    code = " ".join(f"x{R.randrange(10**6)}" for _ in range(400))  # unlike prose(), many different bigrams, so that the whole text is no match
    header = lambda n: "// Copyright (c) 2020 Foo\n// " + "\n// ".join(textwrap.wrap(FULL_TEXTS[n], 60)) + f"\n{code}"
    df = spark.createDataFrame([(k, header(n)) for k, n in enumerate(names)] + [(99, prose(900))], "doc_id int, text string")
    got = {r.doc_id: r.matches for r in license_matches(df, templates=TEMPLATES | FULL_TEXTS).collect()}
    for k, n in enumerate(names):
        assert any(m.template == n and m.dice > 0.99 for m in got[k]), n
    assert not any(m.template in FULL_TEXTS for m in got[99])
