"""All core queries by name."""

from __future__ import annotations

from .audits import AUDITS
from .landing import LANDING
from .merging import MERGING
from .pages import PAGES
from .queries import ALL as ITEMS
from .queries import Query
from .reading import READING

#: name: (query, SQL or None)
ALL: dict[str, tuple[Query, str | None]] = ITEMS | AUDITS | LANDING | MERGING | PAGES | READING
