"""Cleaning against a restatement with Python's own text functions."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import values
from pageloom import config
from pageloom.functions import strings
from pageloom.plans.tables import noisy_texts





def without(patterns, text, flags=re.IGNORECASE):
    for pattern in patterns:
        text = re.compile(pattern, flags).sub("", text)
    return text


def py_lines(text, patterns=config.LINE_NOISE_PATTERNS):
    noise = re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)
    return "\n".join(line for line in text.split("\n") if not noise.search(line.strip()))


def py_people(text):
    flags = re.IGNORECASE | re.MULTILINE | re.DOTALL
    return without([p for p, _ in config.PEOPLE_SECTION_RULES], text, flags)


def py_unrepeated(text):
    lines = text.split("\n")
    stripped = [None, *(line.strip() for line in lines)]
    return "\n".join(
        line for line, before, now in zip(lines, stripped, stripped[1:]) if not now or now != before
    )


PYTHON = {
    strings.remove_css: lambda t: without([p for p, _ in config.CSS_RULES], t),
    strings.remove_noise: lambda t: without(config.NOISE_PATTERNS, t),
    strings.drop_noise_lines: py_lines,
    strings.remove_people_sections: py_people,
    strings.drop_repeated_lines: py_unrepeated,
    strings.rejoin_words: lambda t: re.sub(r"([a-z])\n([a-z]{1,3}\b)", r"\1\2", t),
    strings.collapse_blanks: lambda t: re.sub(r"[ \t]+", " ", t),
    strings.break_sentences: lambda t: re.sub(r"([.!?])\s+([A-Z])", r"\1\n\2", t),
    strings.compress_blank_lines: lambda t: re.sub(r"\n\s*\n(\s*\n)+", "\n\n", t),
    strings.strip_line_ends: lambda t: re.sub(r"[ \t]+$", "", t, flags=re.MULTILINE),
    strings.pystrip: str.strip,
    strings.word_count: lambda t: len(t.split()),
    strings.is_blank: lambda t: not t.strip(),
}


def py_clean(text):
    for step, restated in PYTHON.items():
        if step in (strings.pystrip, strings.word_count, strings.is_blank):
            break
        text = restated(text)
    return text.strip()


PYTHON[strings.clean_text] = py_clean

# Pieces of which random texts are put together: what the patterns look for,
# words that only nearly match, and characters on which dialects differ.
PIECES = [
    "Feedback", "feedbacK", "ſkip to ", "Skip to main", "On this page", "on thiſ page",
    "In thıs article", "İn this article", "=====", "==", "----", "Authors:", "authors: A. B.",
    "Contributors:", "Contributor", "Written by", "written by x", "maintainer:", "Reviewed by y",
    "Copy", "Try", "Ctrl  k", "ctrlK", "Ctrl", "k", "README", "TIPs", "Source code: ", "Teſting",
    "color: red", "color:", "line-height: 2;", "margin:\n", ";", "Arial", "Arialx", "éArial", "Sans",
    "rgb(1,2)", "rgba(", "#fff", "#fffg", "#123456789", "10px", "10pxé", "٣px", "5em", "them",
    "50%", "50%a", "50% ", "Was this page", "helpful?", "Was this page helpful?", "Edit this page",
    "Edit Feedbackthis page", "Last updated by z",
    "a", "b", "ve", "the", "word", "été", "ab́", "A", "Upper", "1", ".", "!", "? ",
    " ", "  ", "\t", "\n", "\n", "\n", "\n\n", " \n", "\n \n\t\n", "\r\n", "\r", "\xa0", " ", "\x1c",
    "\x85", "　", "​", "﻿", " ", "\x0b", "", "_", "'", "\\", "$1",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    chance = random.Random(7)
    made = ["".join(chance.choices(PIECES, k=chance.randint(0, 25))) for _ in range(1500)]
    found = [row["text"] for row in noisy_texts(spark, sf).collect()]
    return [*PIECES, *made, *found]


@pytest.mark.parametrize("step", PYTHON, ids=lambda step: step.__name__)
def test_step_equals_python(spark, texts, step):
    got = values(spark, [(text,) for text in texts], "text string", step(F.col("text")))
    wrong = [(t, g, PYTHON[step](t)) for t, g in zip(texts, got) if g != PYTHON[step](t)]
    assert not wrong, wrong[:3]


def test_cleaning_changes_the_noisy_texts(spark, sf, texts):
    changed = [text for text in texts if py_clean(text) != text.strip()]
    assert len(changed) > len(texts) / 2


def test_null_stays_null(spark):
    assert values(spark, [(None,)], "text string", strings.clean_text(F.col("text"))) == [None]
    assert values(spark, [(None,)], "text string", strings.word_count(F.col("text"))) == [0]
    assert values(spark, [(None,)], "text string", strings.is_blank(F.col("text"))) == [True]


def test_own_rules(spark):
    rules = config.CleaningRules(css=(), noise=(r"(?:foo|bar)\d+", "Baz+"), line_noise=(r"secret \w+",))
    given = "foo12 bar3 bazzz stays\nline with a secret word\nWritten by X\nTail"
    got = values(spark, [(given,)], "text string", strings.clean_text(F.col("text"), rules))
    assert got == ["stays\n\nTail"]
    none = config.CleaningRules(css=(), noise=(), line_noise=(), people_sections=())
    got = values(spark, [("Copy\nCopy\nx",)], "text string", strings.clean_text(F.col("text"), none))
    assert got == ["Copyx"]


def test_line_patterns_do_not_reach_over_lines(spark):
    got = values(spark, [("Ctrl\nk\nCtrl k\nend",)], "text string", strings.drop_noise_lines(F.col("text")))
    assert got == ["Ctrl\nk\nend"]
    own = replace(config.CleaningRules(), line_noise=(*config.LINE_NOISE_PATTERNS, "^ad[0-9]$"))
    got = values(spark, [("Ctrl\nk\n Ctrl k\nad1\nend",)], "text string", strings.drop_noise_lines(F.col("text"), own))
    assert got == ["Ctrl\nk\nend"]


@pytest.mark.parametrize(
    "pattern, hint",
    [
        (r"Was this page helpful\?", "was this page helpful"),
        (r"Contributors?:.*", "contributor"),
        (r"={3,}", "==="),
        (r"Skip to .*", "skip to "),
        (r"a|b", ""),
        (r"[ab]c", ""),
        (r"x*y", ""),
    ],
)
def test_literal_hint(pattern, hint):
    assert strings.literal_hint(pattern) == hint


def test_many_repeated_lines(spark):
    got = values(spark, [("same line\n" * 50_000 + "end",)], "text string", strings.clean_text(F.col("text")))
    assert got == ["same lineend"]
