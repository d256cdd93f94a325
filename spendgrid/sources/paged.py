"""Paged JSON lists ({total, items[], searchTooLong}) as a Spark data source, for batches and for streams.

`spark.read.format("paged_list")` with options url, start, end and dateField posts {dateField: day, pageIndex, pageSize} and what the option filters (a
JSON object: states, parties, codes) asks the server to leave out. Each day is probed (`probes` at once); overflowing days are split by `categories`, a JSON object of category:
[codes]. Rows are (day, slice, complete, page, reported, item JSON). What a slice of one code holds beyond the server's limit is lost: its rows have complete = false, and
one row without an item tells of it if the server gives none. Any other page that overflows, ends early or holds another day's items (dates
in `itemDate`, by default dateField; earlier ones only with exact = false) fails the task.

Option fields, a JSON object of column: [request field, path in an item], adds string columns. Registered by register(), conditions on day narrow what is probed and
read, and equality with a field's column goes to the server; all else stays with Spark.

`spark.readStream.format("paged_list")` reads the same window page by page. Its offset is a cursor (window, day, slice, page); a trigger admits `pagesPerTrigger` pages. Option
`progress` names a folder of the stream's own, where each offset that was given out is kept, so that a restarted stream goes on where its checkpoint stands. A
stream reads to the end of its window and then gives nothing more.

A url of a store (file:, hdfs:, s3:, ...) reads recorded answers instead of a server: <url>/day=<day>/page=<page>/* holds the JSON of one page of so many items.
Options concurrency, spacing, threshold and cooldown set the gate in front of a server (sources.http)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..streaming.cursors import Cursor
from .http import ask, gate_of, post  # noqa: F401  (ask and post are this module's as well)

ZONE = ZoneInfo("Europe/Bucharest")
COLUMNS = "day string, slice string, complete boolean, page int, reported long, item string"


def slices(overflows: Callable[[dict], bool], categories: list[str], codes: Callable[[str], list[str]]) -> list[tuple[dict, bool]]:
    """(filter, complete) requests that cover one day: the day, else its categories, else their codes. A code that still overflows is
    requested and marked incomplete: what it holds beyond the source's limit is lost."""
    if not overflows({}):
        return [({}, True)]
    out: list[tuple[dict, bool]] = []
    for c in categories:
        f = {"cpvCategoryId": c}
        if not overflows(f):
            out.append((f, True))
            continue
        for k in codes(c):
            g = {**f, "cpvCodeId": k}
            out.append((g, not overflows(g)))
    return out


def check_page(answer: dict, day: str, day_of: Callable[[dict], str], exact: bool) -> list[dict]:
    """The items of a page, or ValueError: wrong shape, an overflowing search, or items of other days (earlier ones if not exact)."""
    items = answer.get("items")
    if not isinstance(items, list) or answer.get("searchTooLong"):
        raise ValueError(f"page of {day}: not a complete list")
    for i in items:
        got = day_of(i)
        if (got != day) if exact else (got < day):
            raise ValueError(f"page of {day} holds an item of {got}")
    return items


def local_day(text: str) -> str:
    """The calendar day of an ISO date or time; times with an offset are taken to the server's zone."""
    at = datetime.fromisoformat(text)
    return (at.astimezone(ZONE) if at.tzinfo else at).date().isoformat()


def _next(day: str) -> str:
    return (date.fromisoformat(day) + timedelta(1)).isoformat()


class _Pages(InputPartition):
    """Pages `first` to before `last` of a slice of a day; without last, to its end."""

    def __init__(self, day: str, chosen: dict, complete: bool, first: int = 0, last: int | None = None):
        self.day, self.chosen, self.complete, self.first, self.last = day, chosen, complete, first, last


class Lists:
    """The lists that options name: what a day consists of, and the rows of its pages."""

    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.size = int(self.o.get("pagesize", 200))
        self.start, self.end = self.o["start"], self.o["end"]
        self.fields = {c: (x, x) if isinstance(x, str) else tuple(x) for c, x in json.loads(self.o.get("fields", "{}")).items()}
        self.wanted: dict[str, str] = {}  # column: value that its server field must have
        self.recorded = not self.o["url"].startswith(("http:", "https:"))

    def ask(self, day: str, chosen: dict, page: int, size: int) -> dict:
        if self.recorded:
            return self._recorded(day, page)
        told = {self.fields[c][0]: v for c, v in self.wanted.items()}
        body = {**json.loads(self.o.get("filters", "{}")), **told, self.o["datefield"]: day, **chosen, "pageIndex": page, "pageSize": size}
        gate = gate_of(self.o["url"], concurrency=int(self.o.get("concurrency", 5)), spacing=float(self.o.get("spacing", 0)), threshold=int(self.o.get("threshold", 5)), cooldown=float(self.o.get("cooldown", 60)))
        return ask(self.o["url"], body, gate=gate)

    def _recorded(self, day: str, page: int) -> dict:
        where, at = store.FileSystem.from_uri(self.o["url"])
        found = [f for f in where.get_file_info(store.FileSelector(f"{at}/day={day}/page={page}", allow_not_found=True)) if f.type == store.FileType.File and not f.base_name.startswith(("_", "."))]
        if not found:
            return {"total": 0, "items": []} if page == 0 else {"items": []}
        with where.open_input_stream(found[0].path) as f:
            return json.loads(f.read())

    def of_day(self, day: str) -> list[tuple[str, dict, bool, int]]:
        """(name, filter, complete, total) of the slices that cover a day."""
        codes, told = json.loads(self.o.get("categories", "{}")), {}

        def overflows(chosen: dict) -> bool:
            answer = self.ask(day, chosen, 0, 1)
            told[json.dumps(chosen)] = int(answer.get("total") or 0)
            return answer.get("searchTooLong") is True

        # without categories an overflowing day is itself the last slice
        found = slices(overflows, list(codes), codes.__getitem__) or [({}, False)]
        return [(self.name(f), f, ok, told[json.dumps(f)]) for f, ok in found]

    @staticmethod
    def name(chosen: dict) -> str:
        return ":".join(map(str, chosen.values())) or "day"

    def rows(self, part: _Pages | None) -> Iterator[tuple]:
        if part is None:  # what Spark reads where there is nothing to read
            return
        page, got = part.first, part.first * self.size
        field, exact = self.o.get("itemdate", self.o["datefield"]), self.o.get("exact", "true").lower() == "true"
        name = self.name(part.chosen)
        while part.last is None or page < part.last:
            answer = self.ask(part.day, part.chosen, page, self.size)
            checked = answer if part.complete else {**answer, "searchTooLong": False, "items": answer.get("items") or []}
            items = check_page(checked, part.day, lambda i: local_day(i[field]), exact)
            total = int(answer.get("total") or 0)
            for i in items:
                more = [_at(i, path) for _, path in self.fields.values()]
                if all(more[k] == self.wanted[c] for k, c in enumerate(self.fields) if c in self.wanted):
                    yield part.day, name, part.complete, page, total, json.dumps(i, ensure_ascii=False), *more
            page, got = page + 1, got + len(items)
            if got >= total and part.complete or not items:
                if part.complete and got < total:
                    raise ValueError(f"slice {name} of {part.day} ends after {got} of {total} items")
                break
        if not part.complete and not got:
            yield part.day, name, False, 0, total, None, *(None for _ in self.fields)


def _at(item: dict, path: str) -> str | None:
    for step in path.split("."):
        item = item.get(step) if isinstance(item, dict) else None
    return None if item is None else item if isinstance(item, str) else json.dumps(item, ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.lists = Lists(options)
        self.first, self.last, self.only = self.lists.start, self.lists.end, None

    def partitions(self) -> list[_Pages]:
        n = (date.fromisoformat(self.last) - date.fromisoformat(self.first)).days + 1 if self.first <= self.last else 0
        days = [(date.fromisoformat(self.first) + timedelta(i)).isoformat() for i in range(n)]
        days = [d for d in days if self.only is None or d in self.only]
        with ThreadPoolExecutor(int(self.lists.o.get("probes", 8))) as pool:
            return [_Pages(d, f, ok) for d, found in zip(days, pool.map(self.lists.of_day, days), strict=True) for _, f, ok, _ in found]

    def read(self, part: _Pages) -> Iterator[tuple]:
        return self.lists.rows(part)


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        column, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
        if column == ("day",):
            match f:
                case EqualTo():
                    self._among({value})
                case In():
                    self._among({v for v in value if v is not None})
                case GreaterThanOrEqual() | GreaterThan():
                    self._from(value, isinstance(f, GreaterThan))
                case LessThanOrEqual() | LessThan():
                    self._to(value, isinstance(f, LessThan))
                case IsNotNull():
                    pass  # no row is without a day
                case _:
                    return False
            return True
        if len(column) == 1 and column[0] in self.lists.fields and isinstance(f, EqualTo) and isinstance(value, str) and self.lists.wanted.get(column[0], value) == value:
            self.lists.wanted[column[0]] = value
            return True
        return False

    def _among(self, days: set[str]) -> None:
        self.only = days if self.only is None else self.only & days

    # days compare as text, and so do bounds that are no days
    def _from(self, value: str, beyond: bool) -> None:
        while self.first <= self.last and (self.first <= value if beyond else self.first < value):
            self.first = _next(self.first)

    def _to(self, value: str, before: bool) -> None:
        while self.first <= self.last and (self.last >= value if before else self.last > value):
            self.last = (date.fromisoformat(self.last) - timedelta(1)).isoformat()


class _Progress:
    """Offsets that were given out, one small file each, the last few kept."""

    def __init__(self, folder: str):
        self.where, self.at = store.FileSystem.from_uri(folder) if ":" in folder else (store.LocalFileSystem(), folder)

    def _files(self) -> list[store.FileInfo]:
        return sorted((f for f in self.where.get_file_info(store.FileSelector(self.at, allow_not_found=True)) if f.base_name.endswith(".json")), key=lambda f: f.base_name)

    def last(self) -> Cursor | None:
        found = self._files()
        if not found:
            return None
        with self.where.open_input_stream(found[-1].path) as f:
            return Cursor.of(f.read().decode())

    def give(self, cursor: Cursor) -> None:
        found = self._files()
        number = int(found[-1].base_name[:-5]) + 1 if found else 0
        self.where.create_dir(self.at, recursive=True)
        with self.where.open_output_stream(f"{self.at}/{number:012d}.new") as f:
            f.write(cursor.text().encode())
        self.where.move(f"{self.at}/{number:012d}.new", f"{self.at}/{number:012d}.json")  # whole or not at all
        for old in found[:-8]:
            self.where.delete_file(old.path)


class _StreamReader(DataSourceStreamReader):
    """Offsets are cursors. Spark asks for the latest one without telling where it stands, so the last one given out is kept in the progress folder: never behind Spark's
    own, and ahead of it only where a crash came between the two, whose pages the next batch reads as well."""

    def __init__(self, options: dict):
        self.lists = Lists(options)
        if "progress" not in self.lists.o:
            raise ValueError("a stream of paged lists needs the option progress: a folder of its own, which outlives it")
        self.progress = _Progress(self.lists.o["progress"])
        self.admitted = int(self.lists.o.get("pagespertrigger", 100))

    def initialOffset(self) -> dict:  # noqa: N802
        return asdict(Cursor(self.lists.start, self.lists.start))

    def latestOffset(self) -> dict:  # noqa: N802
        at = self.progress.last() or Cursor(self.lists.start, self.lists.start)
        if at.window != self.lists.start:
            raise ValueError(f"the progress folder belongs to the window of {at.window}")
        to = at
        for _, to in self._walk(at, self.admitted):
            pass
        if to != at:
            self.progress.give(to)
        return asdict(to)

    def _walk(self, at: Cursor, pages: int | None = None, to: Cursor | None = None) -> Iterator[tuple[_Pages, Cursor]]:
        """Pages from a cursor on, slice by slice, each with the cursor behind it: so many pages in all, or up to another cursor."""
        while at.day <= self.lists.end and (pages is None or pages > 0) and at != to and (to is None or at.day <= to.day):
            found = self.lists.of_day(at.day)
            names = [n for n, *_ in found]
            if at.slice is not None and at.slice not in names:  # a day that began to overflow, or no longer does: its slice is read out, and told to be incomplete
                names, found = [at.slice], [(at.slice, _chosen(at.slice), False, (at.page + 1) * self.lists.size)]
            here = names.index(at.slice) if at.slice is not None else 0
            first = at.page
            for k in range(here, len(found)):
                name, chosen, complete, total = found[k]
                left = max(-(-total // self.lists.size), 1) - first
                behind = Cursor(at.window, at.day, 0, names[k + 1]) if k + 1 < len(found) else at.after_day()
                if to is not None and to.day == at.day and to.slice == name and to.page > first:
                    yield _Pages(at.day, chosen, complete, first, to.page), to
                    return
                if pages is not None and left > pages:
                    yield _Pages(at.day, chosen, complete, first, first + pages), Cursor(at.window, at.day, first + pages, name)
                    return
                yield _Pages(at.day, chosen, complete, first), behind
                pages, first = None if pages is None else pages - max(left, 1), 0
                if behind == to or pages is not None and pages <= 0:
                    return
            at = at.after_day()

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        a, b = Cursor(**start), Cursor(**end)
        if (b.day, b.page) < (a.day, a.page) and b.day < a.day:
            raise ValueError(f"the progress folder stands at {b.text()}, behind the stream's own {a.text()}")
        return [p for p, _ in self._walk(a, to=b)]

    def read(self, part: _Pages) -> Iterator[tuple]:
        return self.lists.rows(part)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint holds what is committed


def _chosen(name: str) -> dict:
    """The filter of a slice's name."""
    return {} if name == "day" else dict(zip(("cpvCategoryId", "cpvCodeId"), name.split(":"), strict=False))


class PagedList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return COLUMNS + "".join(f", `{c}` string" for c in json.loads(self.options.get("fields", "{}")))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class PushingPagedList(PagedList):
    """PagedList that takes filters; Spark must be set to push them, as register() does."""

    def reader(self, schema) -> DataSourceReader:
        return _Pushing(dict(self.options))


def record(items: DataFrame, url: str, size: int) -> None:
    """Write items (day, place, item JSON) as recorded answers in pages of so many, by place within each day."""
    turn = F.row_number().over(Window.partitionBy("day").orderBy("place")) - 1
    paged = items.withColumn("turn", turn).withColumn("page", F.floor(F.col("turn") / size).cast("int"))
    totals = items.groupBy("day").agg(F.count("*").alias("total"))
    pages = paged.groupBy("day", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]).alias("items")).join(totals, "day")
    body = F.concat(F.lit('{"total":'), F.col("total").cast("string"), F.lit(',"items":['), F.array_join("items", ","), F.lit("]}"))
    pages.select("day", "page", body.alias("value")).write.partitionBy("day", "page").text(url)


def register(spark: SparkSession) -> None:
    """Make paged_list known to a session, with filters pushed to the server."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushingPagedList)
