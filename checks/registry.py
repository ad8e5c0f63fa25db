"""All checks of all groups."""

from __future__ import annotations

from checks import catalogue as _catalogue
from checks import evaluation as _evaluation
from checks import events as _events
from checks import papers as _papers
from checks import samples as _samples

_GROUPS = (_samples, _papers, _catalogue, _evaluation, _events)

QUERIES = {}
ORACLE = {}
for _group in _GROUPS:
    QUERIES.update(_group.QUERIES)
    ORACLE.update(_group.ORACLE)
