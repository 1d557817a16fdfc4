"""Questions to an outside service, asked once: answers are kept as they come.

    path/bucket=17/<name>.json      lines of key and answer

Rows are dealt by a bucket of their key.  A task reads what its buckets hold, asks what is missing, a few questions at a time,
and writes every few answers to a file of its own, made whole before it gets its name.  So a task that is tried
again, on another executor or in a later run, asks only what was never answered.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BUCKETS = 64
#: Questions of a task at a time, and answers of one file.
CONCURRENT = 8
SAVE_EVERY = 16


class AnswerLog:
    """The kept answers of one bucket, on any file system that pyarrow opens (a path or file:, hdfs:, s3: and the like)."""

    def __init__(self, path: str, bucket: int):
        from pyarrow import fs

        self.files, base = fs.FileSystem.from_uri(path)
        self.folder = f"{base}/bucket={bucket}"

    def known(self) -> dict[str, str]:
        from pyarrow import fs

        out: dict[str, str] = {}
        for found in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if found.base_name.endswith(".json"):
                with self.files.open_input_stream(found.path) as lines:
                    out |= {k: v for k, v in map(json.loads, lines.read().decode().splitlines())}
        return out

    def keep(self, answers: list[tuple[str, str]]) -> None:
        self.files.create_dir(self.folder, recursive=True)
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.folder}/.{name}") as out:
            out.write("".join(json.dumps(a) + "\n" for a in answers).encode())
        self.files.move(f"{self.folder}/.{name}", f"{self.folder}/{name}.json")


def ask_all(questions: list[tuple[str, tuple]], ask: Callable[..., str | None], log: AnswerLog | None, concurrent: int = CONCURRENT, save_every: int = SAVE_EVERY) -> dict[str, str]:
    """The answers to questions (key, arguments), so many at a time; one that fails, or has no answer, is left out and not kept."""
    from concurrent.futures import ThreadPoolExecutor

    def one(question):
        try:
            return question[0], ask(*question[1])
        except Exception:  # an outside service: its failure is expected
            return question[0], None

    out: dict[str, str] = {}
    held: list[tuple[str, str]] = []
    with ThreadPoolExecutor(concurrent) as pool:
        for at in range(0, len(questions), concurrent):
            for key, answer in pool.map(one, questions[at : at + concurrent]):
                if answer is not None:
                    out[key] = answer
                    held.append((key, answer))
            if log is not None and held and (len(held) >= save_every or at + concurrent >= len(questions)):
                log.keep(held)
                held = []
    return out


def question_key(*columns: Column) -> Column:
    """A key of a question: equal for equal values, in which a null differs from an empty text."""
    said = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said), 256)


def answered(rows: DataFrame, columns: list[str], ask: Callable[..., str | None], path: str, version: str = "", buckets: int = BUCKETS, concurrent: int = CONCURRENT, save_every: int = SAVE_EVERY) -> DataFrame:
    """rows with answer: ask(*values of the columns), kept under path; null where it failed.

    Equal questions are asked once.  version: what else an answer depends on, such as a model's name.
    """
    names = rows.columns
    keyed = rows.withColumn("__key", question_key(F.lit(version), *(F.col(c) for c in columns)))
    dealt = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")).repartition("__bucket").sortWithinPartitions("__bucket", "__key")

    def run(batches):
        import pyarrow as pa

        bucket, log, known = None, None, {}
        for batch in batches:
            keys, places = batch.column("__key").to_pylist(), batch.column("__bucket").to_pylist()
            values = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            answers: list[str | None] = [None] * len(keys)
            for own in sorted(set(places)):
                if own != bucket:
                    bucket, log = own, AnswerLog(path, own)
                    known = log.known()
                at = [i for i, b in enumerate(places) if b == own]
                missing = {keys[i]: values[i] for i in at if keys[i] not in known}
                known |= ask_all(list(missing.items()), ask, log, concurrent, save_every)
                for i in at:
                    answers[i] = known.get(keys[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(answers, pa.string())], names=[*names, "answer"])

    return dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))
