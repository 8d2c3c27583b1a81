import random
import re

import pytest

from prefengine.llm import licenses
from prefengine.llm.licenses import BASE, NOTICES, Index, Template, key_places, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def all_alignments(words, templates, weight):
    """Every template at every place, without an index."""
    found = []
    for t, template in enumerate(templates):
        own, keys = template.words.split(), key_places(template)
        total = sum(weight[w] for w in own)
        for start in range(1 - len(own), len(words)):
            hit = [p for p in range(len(own)) if 0 <= start + p < len(words) and words[start + p] == own[p]]
            matched = sum(weight[own[p]] for p in hit)
            if set(keys) <= set(hit) and 100 * matched >= template.share * total:
                found.append((t, start, matched))
    return found


def test_words():
    for text in (None, "", "The MIT-License_2.0\x7fÄRGER KK \U0001f600x\x00y", "a" * 70_000):
        assert [w.decode() for w in words_of(text)] == plain_words(text)


def test_index_loses_no_alignment():
    rng = random.Random(3)
    templates = [*BASE, *NOTICES, Template("odd", "a b a b a", ("b a",), 40), Template("cut", "x y z", ("y z",), 60)]
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    for trial in range(60):
        weight = {w: rng.randint(1, 9) ** 3 for w in vocabulary}
        index, words = Index(templates, weight), []
        for _ in range(12):
            own = rng.choice(templates).words.split()
            words += [w if rng.random() < 0.85 else rng.choice([*vocabulary, "other"]) for w in own][rng.randint(0, 2):]
            words += ["b", "a"] * rng.randint(0, 3)
        got = index.find([w.encode() for w in words])
        assert sorted(got) == sorted(all_alignments(words, templates, weight)), trial


def test_whole_texts_and_defined_cases(spark, docs):
    notice = NOTICES[1].words.split()
    notice[3] = "those"  # a changed word
    rows = [(1, "The GNU General\nPublic License; and again: gnu-general_public license."), (2, None), (3, ""), (None, "MIT License"),
            (5, "mit  LICENSE"), (5, "mit  LICENSE"), (6, "the mit licenses"), (7, "x " * 300_000 + "Apache License"), (8, " ".join(notice)),
            (9, "CC BY-NC 4.0"), (10, "Licensed under CC BY-NC 4.0."), (11, "license " * 2000)]
    got = sorted(licenses.license_digest(docs(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [r.doc_id for r in got].count(5) == 2
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels, by[1].score) == (2, 1, 7, "gpl", 1.0)
    assert tuple(by[2])[1:] == tuple(by[3])[1:] == (0, 0, None, None, "", "", 0.0)
    assert by[None].labels == by[5].base_labels == "mit" and by[6].labels == "" and by[11].n_base == 0
    assert (by[7].n_words, by[7].first_word) == (300_002, 300_000) and by[7].base_labels == "apache"
    assert (by[8].base_labels, by[8].labels) == ("", "apache-2.0") and 0.7 <= by[8].score < 1
    assert by[9].base_labels == "cc-by" and by[10].labels == "cc-by,cc-by-nc"
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.license_digest(docs(rows).limit(0)).count() == 0
    kept = licenses.scan(docs(rows).withColumnRenamed("text", "matches"), text_col="matches").filter("doc_id = 1").first()
    assert [(m.label, m.base, m.start) for m in kept.matches] == [("gpl", True, 1), ("gpl", True, 7)]
    with pytest.raises(ValueError):
        licenses.scan(docs(rows), notices=[Template("x", "a b", ("c",))])
    with pytest.raises(ValueError):
        licenses.scan(docs(rows), notices=[Template("x", "A-b")])
