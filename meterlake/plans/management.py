"""The management calls as methods over a stored log: each answers with DataFrames or plain values."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, read_settings
from ..operators import aggregates, events, prices, retention
from ..schema import DEDUP_KEY, EVENT_COLUMNS, EVENTS
from ..sources import records, storage
from . import dashboard
from .keep import exists, kept, new_path, remove


def _utc(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class UsageLog:
    """A log of request rows with its price table and settings.

    Each push adds a Parquet folder and is compared with the keys that arrived within the window only. What
    retention and the cap leave is a view; folders are rewritten when COMPACT of their rows or more is
    new, and when settings change, so a row is written a few times in its life, not with every push.
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    prices: DataFrame | None = None
    last_import: dict | None = None
    last_recorded_at: datetime.datetime | None = None
    started_at: str = field(default_factory=_utc)
    #: Share of new rows at which folders are rewritten.
    COMPACT = 0.5

    def __post_init__(self) -> None:
        if self.prices is None:
            self.prices = prices.make(self.spark, {})
        self._now: Column = F.current_timestamp()
        self._folders: list[tuple[str, int]] = []  # paths and rows, the first one rewritten before
        self._seen: list[str] = []  # keys and when they arrived
        self._pushes = self._gone = 0
        self.storage_loaded_path = self.price_loaded_path = ""
        self.last_flush_at: str | None = None

    # -- rows ------------------------------------------------------------------------------------

    def _stored(self) -> DataFrame:
        paths = [p for p, n in self._folders if n]
        return self.spark.read.schema(EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    @property
    def rows(self) -> DataFrame:
        """What retention and the cap leave of the log."""
        return retention.prune(self._stored(), self._now, self.settings.retention_days, self.settings.max_details_per_model)

    @property
    def evicted_total(self) -> int:
        return self._gone + sum(n for _, n in self._folders) - self.rows.count()

    def _compact(self) -> None:
        old = self._folders
        path = new_path(self.spark)
        self.rows.write.parquet(path)
        n = self.spark.read.schema(EVENTS).parquet(path).count()
        self._gone += sum(x for _, x in old) - n
        self._folders = [(path, n)]
        for p, _ in old:
            remove(self.spark, p)

    def _keys(self, rows: DataFrame, arrived: Column) -> None:
        path = new_path(self.spark, "keys")
        rows.select(*DEDUP_KEY, arrived.alias("arrived")).write.parquet(path)
        self._seen.append(path)

    def _known(self) -> DataFrame:
        """Keys that arrived within the window."""
        if not self._seen:
            return self.spark.createDataFrame([], EVENTS).select(*DEDUP_KEY)
        since = self._now - F.make_interval(mins=F.lit(self.settings.dedup_window_minutes))
        return self.spark.read.parquet(*self._seen).filter(F.col("arrived") >= since)

    def _append(self, new: DataFrame, arrived: Column, persist: bool = True) -> None:
        path = new_path(self.spark)
        new.select(*EVENT_COLUMNS).write.parquet(path)
        added = self.spark.read.schema(EVENTS).parquet(path)
        n, last = added.agg(F.count("*"), F.unix_micros(F.max("ts"))).first()
        self._pushes += 1
        if not n:
            return remove(self.spark, path)
        if last is not None:
            at = datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=last)
            self.last_recorded_at = max(at, self.last_recorded_at or at)
        if self.settings.dedup_window_minutes:
            self._keys(added, arrived)
        if persist and self.settings.storage_enabled:
            storage.append_lines(added, self.settings.storage_path)
            self.last_flush_at = _utc()
        self._folders.append((path, n))
        if len(self._seen) > 100:  # one folder again, of what the window still holds
            old, self._seen = self._seen, []
            known = self.spark.read.parquet(*old).filter(F.col("arrived") >= self._now - F.make_interval(mins=F.lit(self.settings.dedup_window_minutes)))
            self._keys(known, F.col("arrived"))
            for p in old:
                remove(self.spark, p)
        total = sum(x for _, x in self._folders)
        if total - self._folders[0][1] >= self.COMPACT * total or len(self._folders) > 200:
            self._compact()

    # -- settings --------------------------------------------------------------------------------

    def configure(self, yaml_text: str, now: Column) -> Settings:
        """Settings of a YAML text, others their default; an empty salt there leaves the one in use."""
        new = read_settings(yaml_text)
        return self._use(new.patched(api_key_hash_salt=new.api_key_hash_salt or self.settings.api_key_hash_salt), now)

    def patch(self, now: Column, **values) -> Settings:
        """Some settings; the others stay as they are."""
        return self._use(self.settings.patched(**values), now)

    def _use(self, settings: Settings, now: Column) -> Settings:
        """In this order: settings, stored lines, saved prices, retention, known keys."""
        if self._folders:
            self._compact()  # what the old settings have removed stays so
        self.settings, self._now = settings, now
        if not settings.storage_enabled:
            self.storage_loaded_path = ""
        elif self.storage_loaded_path != settings.storage_path:
            if exists(self.spark, settings.storage_path):
                rows = storage.replay_lines(self.spark, settings.storage_path, self.rows, now)
                self._append(rows.withColumn("ingest_seq", records.push_number(self._pushes) + records.position()), now, persist=False)
            self.storage_loaded_path = settings.storage_path
        if self.price_loaded_path != settings.price_storage_path:
            self.prices = kept(prices.read(self.spark, settings.price_storage_path))
            self.price_loaded_path = settings.price_storage_path
        if self._folders:
            self._compact()
        old, self._seen = self._seen, []
        if settings.dedup_window_minutes and self._folders:
            self._keys(self.rows.filter(F.col("ts") >= now - F.make_interval(mins=F.lit(settings.dedup_window_minutes))), F.col("ts"))
        for p in old:
            remove(self.spark, p)
        return self.settings

    # -- calls -----------------------------------------------------------------------------------

    def record(self, raw: DataFrame, now: Column) -> None:
        """Store pushed records (a text column `value`): decoded, normalized, without repeats within the window of arrival."""
        self._now = now
        new = records.normalize(records.decode(raw), now, self.settings, records.push_number(self._pushes) + records.position())
        if self.settings.dedup_window_minutes:
            new = retention.without_known(retention.dedup_live(new, self.settings.dedup_window_minutes), self._known())
        self._append(new, now)

    def usage(self) -> DataFrame:
        return aggregates.hierarchy(self.rows)

    def usage_document(self) -> DataFrame:
        """The lines of a document with all rows and the number of failures."""
        return storage.snapshot_lines(self.rows, "{" + f'"failed_requests":{self._failures()},')

    def dashboard_data(self, generated_at: str) -> DataFrame:
        """usage_document() with its time: the full dump of older dashboards."""
        return storage.snapshot_lines(self.rows, "{" + f'"failed_requests":{self._failures()},"generated_at":"{generated_at}",')

    def _failures(self) -> int:
        return self.rows.filter("failed").count()

    def export(self, exported_at: str) -> DataFrame:
        return storage.export_document(self.rows, self.settings, exported_at)

    def write_export(self, exported_at: str, path: str) -> None:
        storage.write_snapshot(self.rows, self.settings, exported_at, path)

    def import_file(self, path: str, now: Column) -> dict:
        """Counts of an import; ImportRejected leaves the log as it is."""
        rows = retention.normalize_import(storage.read_snapshot(self.spark, path, storage.MOST_RECORDS, storage.MOST_BYTES), now)
        rows = rows.withColumn("ingest_seq", records.push_number(self._pushes) + F.col("ingest_seq"))
        self._now = now
        classified = kept(retention.classify_import(rows, self.rows, now, self.settings.retention_days))
        self.last_import = retention.import_counts(classified).first().asDict()
        self._append(classified.filter("outcome = 'added'").select(*EVENT_COLUMNS), now, persist=self.settings.storage_enabled)
        return self.last_import

    def summary(self, now: Column) -> dict[str, DataFrame]:
        return dashboard.summary(self.rows, self.prices, now)

    def events(self, options: dict[str, str], now: Column) -> tuple[DataFrame, int]:
        page, total = events.page(self.rows, events.Query.parse(options), now)
        return page, total.first()["total"]

    def put_price(self, model: str, prompt: float, completion: float, cache: float | None = None) -> DataFrame:
        return self._price(prices.upsert(self.prices, model, prompt, completion, cache))

    def delete_price(self, model: str) -> DataFrame:
        return self._price(prices.delete(self.prices, model))

    def _price(self, table: DataFrame) -> DataFrame:
        """Use a changed table; it is saved where configure() has read it."""
        self.prices = kept(table)
        if self.price_loaded_path:
            prices.save(self.prices, self.price_loaded_path, _utc())
        return self.prices

    def health(self) -> dict:
        counts = aggregates.overall(self.rows).first()
        last = self.last_recorded_at
        return {
            "status": "ok", "detail_count": counts["total_requests"], "total_requests": counts["total_requests"], "evicted_total": self.evicted_total, "config": self.settings.public(),
            "storage": {"enabled": self.settings.storage_enabled, "path": self.settings.storage_path, "loaded_path": self.storage_loaded_path, "last_flush_at": self.last_flush_at},
            "runtime": {"seen_count": self._known().select(*DEDUP_KEY).distinct().count(), "started_at": self.started_at, "last_recorded_at": _utc(last) if last else None, "last_import": self.last_import},
            "last_import": self.last_import, "generated_at": _utc(),
        }
