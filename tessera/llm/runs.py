"""Streams key runs out of sorted partitions, so a task holds one bounded block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Yields (frame, starts): frames of whole key runs, starts[k] the first row of run k, with a final end.

    Batches must be sorted by keys. The last, possibly open run of a batch is carried into the next.
    """
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = _changes(pdf, keys)
        if rest and not _same(rest[-1], pdf, keys):
            whole = pd.concat(rest, ignore_index=True)
            yield whole, np.array([0, len(whole)])
            rest = []
        if not len(new):
            rest.append(pdf)
            continue
        if rest:
            head = pd.concat([*rest, pdf.iloc[: new[0]]], ignore_index=True)
            yield head, np.array([0, len(head)])
            body, starts = pdf.iloc[new[0] : new[-1]], new - new[0]
        else:
            body, starts = pdf.iloc[: new[-1]], np.concatenate([[0], new])
        if len(body):
            yield body.reset_index(drop=True), starts
        rest = [pdf.iloc[new[-1] :]]
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        yield whole, np.array([0, len(whole)])


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    diff = np.zeros(max(0, len(pdf) - 1), dtype=bool)
    for k in keys:
        v = pdf[k].to_numpy()
        diff |= v[1:] != v[:-1]
    return np.flatnonzero(diff) + 1


def _same(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(a[k].iloc[-1] == b[k].iloc[0] for k in keys)


def over_runs(keys: list[str], kernel: Callable) -> Callable:
    """mapInPandas function that applies kernel(frame, starts) -> DataFrame or None to frames of whole runs."""

    def apply(batches):
        for frame, starts in runs(batches, keys):
            out = kernel(frame, starts)
            if out is not None and len(out):
                yield out

    return apply
