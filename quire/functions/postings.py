"""Term counts of a batch of documents, as arrays: no row per occurrence.

Token lists of a batch are numbered by its distinct terms, and (document, term)
pairs are counted by sorting numbers. So a term becomes a string again once for
each of its postings, and nothing is grouped row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.functions._ship import ship_by_value

ship_by_value(__name__)


def numbered(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of every element, the elements) of a column of lists."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), lists.flatten()


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of every value, the distinct values in order)."""
    coded = values.dictionary_encode(null_encoding="encode")
    by = pc.sort_indices(coded.dictionary)
    place = np.empty(len(by), np.int64)
    place[by.to_numpy()] = np.arange(len(by))
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(by)


def counted(row: np.ndarray, code: np.ndarray, rows: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the distinct pairs, by code and row."""
    pair = code * rows + row
    if weights is None:
        pair, n = np.unique(pair, return_counts=True)
    else:
        pair, at = np.unique(pair, return_inverse=True)
        n = np.bincount(at, weights, minlength=len(pair)).astype(np.int64)
    return pair % rows, pair // rows, n


def counted_terms(fields: list[str], whole: int | None, parts: list[int], schema: pa.Schema):
    """Rows (doc, id, joined, t0, t1, ...) of token lists -> postings. Where
    ``joined``, the tokens of the fields ``parts`` are those of ``whole`` too."""
    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch.column("joined").to_numpy(zero_copy_only=False)
            lists = [numbered(batch.column(f"t{i}")) for i in range(len(fields))]
            code, terms = codes_of(pa.concat_arrays([t for _, t in lists]))
            codes = np.split(code, np.cumsum([len(t) for _, t in lists])[:-1])
            rows = [r for r, _ in lists]
            if whole is not None:
                also = [joined[rows[i]] for i in parts]
                codes[whole] = np.concatenate([codes[whole], *[codes[i][x] for i, x in zip(parts, also)]])
                rows[whole] = np.concatenate([rows[whole], *[rows[i][x] for i, x in zip(parts, also)]])
            for i, name in sorted(enumerate(fields), key=lambda x: x[1]):  # rows come as a bucket is sorted
                row, term, tf = counted(rows[i], codes[i], batch.num_rows)
                if not len(row):
                    continue
                dl, at = np.bincount(rows[i], minlength=batch.num_rows), pa.array(row)
                yield pa.record_batch([pa.array([name]).take(pa.array(np.zeros(len(row), np.int32))), terms.take(pa.array(term)), batch.column("doc").take(at),
                                       batch.column("id").take(at), pa.array(tf), pa.array(dl[row].astype(np.int32))], schema=schema)

    return count
