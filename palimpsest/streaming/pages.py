"""A group's dictionary in a map state, many entries to a value."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Collection, Iterable, Mapping

from pyspark.sql.streaming import StatefulProcessorHandle

#: Entries of a page on average, at most: about as many as take the time of a call.
PAGE = 2048


class Pages:
    """Values of JSON by name for the current group, some PAGE of them in each value of a map state, as a call to the store costs more than what it moves.

    The page of a name follows from its checksum; there is a power of two of pages, and more when they
    are full on average. So a look-up reads the pages of its names, whatever the dictionary holds, and
    no more than one page is held at a time. Page 0 also holds how many pages and entries there are.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, "page int", "pages int, entries long, dictionary string")

    def head(self) -> tuple[int, int, dict | None]:
        row = self.state.getValue((0,))
        return (row[0], row[1], json.loads(row[2])) if row else (1, 0, None)

    def page(self, k: int) -> dict | None:
        row = self.state.getValue((k,))
        return json.loads(row[2]) if row else None

    def write(self, k: int, held: dict, pages: int = 0, entries: int = 0) -> None:
        self.state.updateValue((k,), (pages, entries, json.dumps(held, ensure_ascii=False)))

    @staticmethod
    def dealt(names: Iterable[str], pages: int) -> dict[int, list[str]]:
        by_page = defaultdict(list)
        for name in names:
            by_page[zlib.crc32(name.encode()) & pages - 1].append(name)
        return by_page

    def look_up(self, names: Collection[str]) -> dict:
        """Values of those names that are known."""
        if not names:
            return {}
        found, (pages, _, first) = {}, self.head()
        for k, own in self.dealt(names, pages).items():
            held = (self.page(k) if k else first) or {}
            found.update((name, held[name]) for name in own if name in held)
        return found

    def change(self, put: Mapping, gone: Collection[str] = ()) -> None:
        """Adds or replaces `put` and takes out `gone`, which `put` doesn't hold; a dictionary that is empty leaves nothing behind."""
        if not put and not gone:
            return
        pages, entries, first = self.head()
        had = entries
        if entries + len(put) > pages * PAGE:
            pages, first = self.spread(pages, entries, first, entries + len(put))
        before = first is not None
        for k, own in self.dealt([*put, *gone], pages).items():
            was = (self.page(k) if had else None) if k else first
            held = dict(was or {})
            for name in own:
                if name in put:
                    held[name] = put[name]
                else:
                    held.pop(name, None)
            entries += len(held) - len(was or {})
            if not k:
                first = held
            elif held:
                self.write(k, held)
            elif was is not None:
                self.state.removeKey((k,))
        if entries:
            self.write(0, first or {}, pages, entries)
        elif before:
            self.state.removeKey((0,))

    def spread(self, pages: int, entries: int, first: dict | None, wanted: int) -> tuple[int, dict | None]:
        """The number of pages for `wanted` entries and page 0, after the others have been dealt anew; page 0 is left to write."""
        more = pages
        while wanted > more * PAGE:
            more *= 2
        for k in range(pages if entries else 0):
            held = (self.page(k) if k else first) or {}
            parts = self.dealt(held, more)
            if k and held and k not in parts:
                self.state.removeKey((k,))
            for to, own in parts.items():
                if to:
                    self.write(to, {name: held[name] for name in own})
            if not k and first is not None:
                first = {name: held[name] for name in parts.get(0, ())}
        return more, first
