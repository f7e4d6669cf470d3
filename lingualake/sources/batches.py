"""Arrow batches of bounded size: a file's rows leave as they are found, whatever the number of files a batch holds and the size of a file."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows of a batch at most, and code points of files after which one ends.
ROWS, TEXT = 4096, 1 << 22


def walked(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str | None], Iterable[tuple]], names: list[str], types: tuple) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and the rows that `rows_of` gives for each content of `batches` (doc_id, content)."""
    for batch in batches:
        ids, contents = batch.column("doc_id"), batch.column("content")
        owners: list[int] = []
        rows: list[tuple] = []

        def built() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            done = pa.RecordBatch.from_arrays([ids.take(pa.array(owners, pa.int64())), *columns], ["doc_id", *names])
            owners.clear()
            rows.clear()
            return done

        read = 0
        for k in range(batch.num_rows):
            text = contents[k].as_py()
            for row in rows_of(text):
                owners.append(k)
                rows.append(row)
                if len(rows) == ROWS:
                    yield built()
            read += len(text or "")
            if rows and read > TEXT:
                yield built()
                read = 0
        if rows:
            yield built()
