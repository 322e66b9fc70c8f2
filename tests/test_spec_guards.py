"""The strings that a pattern requires: no match of a rule is without one."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.operators import specs
from varve.operators.spec_rules import RULES

GUARDED = [r[1] for r in RULES if specs.required(r[1])]


@pytest.mark.parametrize("pattern", GUARDED)
def test_matches_have_a_required_string(pattern):
    @settings(max_examples=40, deadline=None, database=None)
    @given(st.from_regex(pattern))
    def holds(text):
        assert any(x in text for x in specs.required(pattern))

    holds()


def test_what_is_required():
    assert specs.required(r"\b(?:uhd|4k)\b") == ["uhd", "4k"] and specs.required(r"a+|xyz") is None
    assert specs.required(r"(?:core\s?)?i7") == ["i7"] and specs.required(r"(ab)*c") is None and specs.required(r"(?:abc){2}d") == ["abc"]
    assert len(GUARDED) >= 75


def test_rules_say_the_same_without_guards(spark, monkeypatch):
    """Texts of several rules' matches each, over all families that the sampler reaches."""
    import random

    rng = random.Random(5)
    parts = ["4k", "oled", "qd-oled", "144 hz", "1 ms", "hdr10+", "55 po", "ryzen 7", "core i7-1270", "rtx 4070", "16 go ram", "1 to ssd", "wifi 6e", "bluetooth 5.3", "hdmi 2.1", "usb-c", "aluminium", "5000 pa", "3500 tr/min", "16 couverts", "18 v", "1200 w", "autonettoyant", "ip68", "5 atm", "8 ans et plus", "1000 pieces", "spf 50", "garantie de 2 ans", "100 % coton", "i5 ", "puce m2"]
    rows = [(k, " ".join(rng.sample(parts, 6)), rng.choice([None, "televiseurs", "outils", "beaute-sante", "jouets", "cuisine"])) for k in range(120)]
    items = spark.createDataFrame(rows, "product_id long, title string, category string").repartition(4)
    guarded = sorted(map(str, specs.extract(items, description=None).collect()))
    hits = sorted(map(str, specs.rule_hits(items, description=None).collect()))
    monkeypatch.setattr(specs, "may_match", lambda text, pattern: None)
    assert guarded == sorted(map(str, specs.extract(items, description=None).collect())) and len(guarded) > 400
    assert hits == sorted(map(str, specs.rule_hits(items, description=None).collect()))
