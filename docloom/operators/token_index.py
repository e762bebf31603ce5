"""A posting index that is kept in levels: each refresh adds a sorted run, and runs of like size are merged.

A run is a table of (token, id), sorted by both over all its files, in small row groups whose minima and maxima let a
look-up by token or prefix skip the others. Beside it stand its tombstones: the documents that its refresh changed or
removed, whose postings in older runs count no more. A merge leaves out what is dead, and the oldest run needs no tombstones.
A run is merged with the one before it while that has less than FANOUT times its postings, so there are few runs, and a posting is written
a logarithmic number of times.

All runs of a refresh appear together as one version of a store, so readers never see half of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.operators.components import stored
from docloom.sources.snapshots import SnapshotStore

#: A run is merged into the one before it if that has fewer than so many times its postings.
FANOUT = 4
#: Bytes of a row group: what a look-up reads at least.
ROW_GROUP = 1 << 20
#: So many documents that are left are handed to the next word's look-up as a filter on its postings.
HANDED_ON = 1000


class TokenIndex:
    """The index in one folder, of documents with an id column and a text."""

    def __init__(self, spark: SparkSession, root: str, id: str = "doc_id"):
        self.store, self.id, self.spark = SnapshotStore(spark, root), id, spark

    def runs(self) -> list[dict]:
        """name and postings of each run, the oldest first."""
        return self.store.version().notes.get("runs", [])

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, column: str = "search_text") -> None:
        """Puts in new and changed documents (one row for each id), takes out ``removed`` ones (their ids)."""
        version = self.store.version()
        tables, runs = self.store.tables(version.number), list(version.notes.get("runs", []))
        postings = stored(search.build_token_index(changed, self.id, column))
        gone = changed.select(self.id) if removed is None else changed.select(self.id).union(removed.select(self.id))
        gone, count, drop = stored(gone.distinct()), postings.count(), []
        while runs and runs[-1]["postings"] < FANOUT * max(count, 1):
            older = runs.pop()
            drop += [f"run-{older['name']}", f"gone-{older['name']}"]
            postings = tables[f"run-{older['name']}"].join(gone, self.id, "left_anti").select("token", self.id).unionByName(postings)
            gone = tables[f"gone-{older['name']}"].union(gone).distinct()
            count += older["postings"]
        name = f"{version.number + 1:06d}"
        if not runs:
            gone = gone.limit(0)
        written = {f"run-{name}": postings.repartitionByRange("token", self.id).sortWithinPartitions("token", self.id), f"gone-{name}": gone}
        self.store.commit(written, version.number, {"runs": [*runs, {"name": name, "postings": count}]}, drop, **{"parquet.block.size": ROW_GROUP})

    def postings(self, which: Column | None = None) -> DataFrame:
        """token and id of the documents as they are, of those postings for which ``which`` holds; a filter that files can use is used there."""
        version = self.store.version()
        tables, names = self.store.tables(version.number), [r["name"] for r in version.notes.get("runs", [])]
        live = []
        for i, name in enumerate(names):
            run = tables[f"run-{name}"]
            run = run if which is None else run.where(which)
            newer = [tables[f"gone-{n}"] for n in names[i + 1 :]]
            live.append(run.join(reduce(DataFrame.union, newer), self.id, "left_anti").select("token", self.id) if newer else run)
        if not live:
            raise ValueError("the index has no runs yet")
        return reduce(DataFrame.unionByName, live)

    def search(self, query: str) -> DataFrame:
        """Ids of the documents that hold, for every word of the query, a word that it starts, with or without the article.

        Words are taken with the fewest postings first. Once few documents are left, the next word's postings are asked
        for those only, which skips row groups without them; else both are joined by id.
        """
        starts = lambda forms: F.col("token").startswith(forms[0]) | F.col("token").startswith(forms[1])
        groups = search.query_words(query)
        if not groups:
            return self.postings().select(self.id).limit(0)
        sizes = self.postings(reduce(Column.__or__, map(starts, groups))).agg(*[F.count_if(starts(g)) for g in groups]).first()
        found = None
        for _, forms in sorted(zip(sizes, groups, strict=True)):
            if found is None:
                found = self.postings(starts(forms)).select(self.id).distinct()
                continue
            left = found.limit(HANDED_ON + 1).collect()
            if len(left) <= HANDED_ON:
                found = self.postings(starts(forms) & F.col(self.id).isin([r[0] for r in left])).select(self.id).distinct()
            else:
                found = found.join(self.postings(starts(forms)).select(self.id), self.id, "left_semi")
        return found
