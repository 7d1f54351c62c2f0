"""White space and words of a page, worked out in fewer steps, against the plain way."""

import random
import re

from auditloom.sources import html


def test_runs_and_words_are_those_of_a_plain_search(monkeypatch):
    draw = random.Random(9)
    searched, search = [], re.search
    monkeypatch.setattr(re, "search", lambda *a, **k: searched.append(a) or search(*a, **k))
    for _ in range(2000):
        s = "".join(draw.choices(" \t\n ﻿\x1c ​ab_é1-", k=draw.randrange(30)))
        plain = re.sub(r"[\s ﻿]+", " ", s).strip()
        assert html.collapse(s) == plain
        assert html.parse(f"<body><p>{s}</p>", "http://a.test/")["words"] == sum(bool(search(r"[^\W_]", w)) for w in plain.split(" "))
    assert len(searched) <= 2 * 2000  # none for each word
