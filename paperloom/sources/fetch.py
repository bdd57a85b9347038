"""Files fetched over HTTP, each with its state, and tables copied where they are absent."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT, TRIES, BACKOFF = 30.0, 5, 1.0
FETCHED = "url string, name string, status string, n_bytes bigint, error string"


def _get(url: str, kind: str, timeout: float, tries: int, backoff: float) -> bytes:
    """The body of a response of the wanted type; connections that fail are tried again, ever later."""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as response:
                if response.status != 200 or kind not in response.headers.get("Content-Type", ""):
                    raise ValueError(f"status {response.status}, type {response.headers.get('Content-Type')}")
                return response.read()
        except urllib.error.HTTPError as e:
            raise ValueError(f"status {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == tries:
                raise
            time.sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("no tries")


def fetch(urls: DataFrame, folder: str, url: str = "url", name: str = "name", kind: str = "application/pdf", timeout: float = TIMEOUT, tries: int = TRIES, backoff: float = BACKOFF, pause: float = 0.0) -> DataFrame:
    """(url, name, status, n_bytes, error): each file stored under its name in a folder that all executors mount.

    A name that is there already is SKIPPED; what isn't status 200 of the
    wanted type is an ERROR with its reason, and the job goes on; a file
    appears under its name only when it is whole. Null addresses and names
    are an ERROR. status_tally counts the states. How many files are fetched
    at once follows from the partitions of urls.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for u, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if not u or not n or os.path.basename(n) != n:
                        raise ValueError("no address or no plain name")
                    path = os.path.join(folder, n)
                    if os.path.exists(path):
                        rows.append((u, n, "SKIPPED", os.path.getsize(path), None))
                        continue
                    body = _get(u, kind, timeout, tries, backoff)
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(body)
                    os.replace(part, path)
                    rows.append((u, n, "SUCCESS", len(body), None))
                    time.sleep(pause)
                except Exception as e:  # the file's fault, reported with it
                    rows.append((u, n, "ERROR", 0, repr(e)[:500]))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["url", "name", "status", "n_bytes", "error"])

    return urls.select(F.col(url), F.col(name)).mapInArrow(run, FETCHED)


def copy_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file or folder between any two file systems Spark knows, unless the target exists; whether it was copied.

    The copy appears under its name only when it is whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    there, part = path(target), path(f"{target}.part-{os.urandom(4).hex()}")
    out = there.getFileSystem(conf)
    if out.exists(there):
        return False
    jvm.org.apache.hadoop.fs.FileUtil.copy(path(source).getFileSystem(conf), path(source), out, part, False, conf)
    if not out.rename(part, there):
        out.delete(part, True)
        raise RuntimeError(f"{target} can't be written")
    return True
