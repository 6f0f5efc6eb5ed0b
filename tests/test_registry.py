"""Names of queries are given once."""

import pytest

from traceaudit.plans import base


def test_names_are_given_once(monkeypatch):
    monkeypatch.setattr(base, "QUERIES", {})
    base.query()(test_names_are_given_once)
    with pytest.raises(ValueError, match="already"):
        base.query()(test_names_are_given_once)
