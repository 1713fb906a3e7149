"""The generation loop: every distinct prompt is asked once, failures are tried again, replies are kept.

Prompts are known by a digest of (system, user); rows that share one share its reply.  What a ledger holds already is
not asked.  The rest goes out in chunks of at most ``chunk`` prompts, and each chunk's replies are listed before the next is asked, so a
stop or a lost executor costs the calls of one chunk at most.  A row whose call raises, or whose reply the check
refuses, has an error; after the last chunk these rows alone are asked again, ``tries`` times in all, with a pause
that doubles.  What still fails is returned with its last error and asked again by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import Ledger
from .tables import saved

REPLIES = "key string, reply string"


def key_of(system: str = "system", user: str = "user") -> Column:
    """A prompt's digest; the parts are kept apart by their lengths."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.sha2(F.concat(F.length(part(system)).cast("string"), F.lit(":"), part(system), part(user)), 256)


def asked(prompts: DataFrame, call: Callable[[str, str], str], accept: Callable[[str], bool] | None = None) -> DataFrame:
    """(key, reply, error) of prompts (key, system, user): one call a row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for key, system, user in zip(*[b.column(c).to_pylist() for c in ("key", "system", "user")], strict=True):
                try:
                    reply = call(system, user)
                    error = "refused by the check" if accept and not accept(reply) else None
                except Exception as e:  # whatever a transport raises is that row's error, not the job's
                    reply, error = None, f"{type(e).__name__}: {e}"[:500]
                out.append((key, None if error else reply, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["key", "reply", "error"])

    return prompts.mapInArrow(run, "key string, reply string, error string")


def generate(prompts: DataFrame, call: Callable[[str, str], str], ledger: Ledger, run: str, chunk: int = 10_000, tries: int = 3, pause: float = 1.0, accept: Callable[[str], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompts with reply, failures (key, error)); ``ledger`` keeps (key, reply), ``run`` names this attempt."""
    keyed = saved(prompts.withColumn("key", key_of()))
    one = keyed.groupBy("key").agg(F.first("system").alias("system"), F.first("user").alias("user"))
    todo = saved(ledger.pending(one, ["key"]))
    left, failed, number = todo.count(), None, 0
    for attempt in range(tries):
        if not left:
            break
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        chunks, wrong = -(-left // chunk), None
        for k in range(chunks):
            part = todo.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == k) if chunks > 1 else todo
            got = saved(asked(part, call, accept))  # calls are made here, and only here
            ledger.append(got.filter("error is null").select("key", "reply"), run, number)
            number += 1
            bad = got.filter("error is not null").select("key", "error")
            wrong = bad if wrong is None else wrong.unionByName(bad)
        failed = saved(wrong)
        todo = saved(todo.join(failed.select("key"), "key", "left_semi"))
        left = todo.count()
    if failed is None:
        failed = prompts.sparkSession.createDataFrame([], "key string, error string")
    return keyed.join(ledger.rows().dropDuplicates(["key"]), "key", "left"), failed
