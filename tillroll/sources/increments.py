"""Features kept up to date by new files only.

Transaction files land in a folder.  A refresh reads the files that no increment holds yet, aggregates their lines to
partials (sums, last dates and the keys behind the distinct counts) and writes these as one more increment; the
features are the merged partials of all increments.  A manifest says which files, by name, length and time, each increment was made
from.  It is published as a new version after the partials are complete, so a refresh that is cut off leaves the old
state.  An increment with a file that has changed or gone is dropped, and its other files are read again.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import features as FE
from tillroll.operators.clean import clean
from tillroll.session import path_exists
from tillroll.sources.versions import Versions


class Increments:
    """``read`` gives the lines (RETAIL_SCHEMA) of a list of files."""

    PARTIALS = {"rfm": (FE.rfm_partials, FE.merged_rfm_partials), "product": (FE.product_partials, FE.merged_product_partials)}

    def __init__(self, spark: SparkSession, landing: str, path: str, read: Callable[[list[str]], DataFrame]):
        self.spark, self.landing, self.path, self.read = spark, landing.rstrip("/"), path, read
        self.manifests = Versions(spark, f"{path}/manifests")

    def _listed(self) -> dict[str, str]:
        """Name -> length and time of the files in the landing folder."""
        if not path_exists(self.spark, self.landing):
            return {}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.landing)
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        files = [s for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        return {s.getPath().getName(): f"{s.getLen()}:{s.getModificationTime()}" for s in files}

    def _known(self) -> dict[int, dict[str, str]]:
        """Increment -> its files, a row a file."""
        known: dict[int, dict[str, str]] = {}
        try:
            rows = self.manifests.latest().collect()
        except FileNotFoundError:
            return known
        for r in rows:
            known.setdefault(r["increment"], {})[r["file"]] = r["stamp"]
        return known

    def _publish(self, known: dict[int, dict[str, str]]) -> None:
        rows = [(n, f, stamp) for n, files in known.items() for f, stamp in files.items()]
        self.manifests.publish(self.spark.createDataFrame(rows, "increment bigint, file string, stamp string").coalesce(1))

    def _next(self) -> int:
        """A number that no manifest has ever used."""
        used = self.spark.read.parquet(f"{self.path}/manifests").agg({"increment": "max"}).first()[0] if self._known() else None
        return 0 if used is None else used + 1

    def refresh(self) -> list[str]:
        """Take up what is new; returns the names of the files that were read."""
        listed, known = self._listed(), self._known()
        live = {n: files for n, files in known.items() if all(listed.get(f) == stamp for f, stamp in files.items())}
        held = {f for files in live.values() for f in files}
        new = {f: stamp for f, stamp in sorted(listed.items()) if f not in held}
        if new:
            number = self._next()
            lines = self.read([f"{self.landing}/{f}" for f in new])
            for variant, (partials, _) in self.PARTIALS.items():
                partials(clean(lines, variant)).write.mode("overwrite").parquet(self._of(number, variant))
            live[number] = new
        if live != known:
            self._publish(live)
        return list(new)

    def compact(self) -> None:
        """Fold the increments into one."""
        known = self._known()
        if len(known) > 1:
            number = self._next()
            for variant, (_, merged) in self.PARTIALS.items():
                merged(self._partials(variant)).write.mode("overwrite").parquet(self._of(number, variant))
            self._publish({number: {f: stamp for files in known.values() for f, stamp in files.items()}})

    def _of(self, number: int, variant: str) -> str:
        return f"{self.path}/{variant}/increment-{number}"

    def _partials(self, variant: str) -> DataFrame:
        known = sorted(self._known())
        if not known:
            raise FileNotFoundError(f"no increment in {self.path}")
        return self.spark.read.parquet(*[self._of(n, variant) for n in known])

    def rfm(self) -> DataFrame:
        return FE.rfm_of_partials(self._partials("rfm"))

    def product_features(self, **parameters) -> DataFrame:
        return FE.product_features_of_partials(self._partials("product"), **parameters)
