"""JDBC source/sink with environment-driven options.

Any JDBC database whose driver is on the classpath works; tests use the
embedded Derby engine that ships with Spark (in-process, no server).
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ENV_KEYS = {"host": "DB_HOST", "port": "DB_PORT", "database": "DB_NAME", "user": "DB_USER",
            "password": "DB_PASSWORD", "ssl_ca": "DB_SSL_CA"}


def jdbc_options(env: Mapping[str, str] | None = None, *, scheme: str = "mysql", url: str | None = None,
                 fetchsize: int = 10_000) -> dict:
    """Options for ``spark.read.jdbc`` from environment-style settings.

    With ``url`` given, host/port/database are ignored.  A CA certificate
    path turns on certificate verification.
    """
    env = os.environ if env is None else env
    get = lambda k, d=None: env.get(ENV_KEYS[k], d)
    if url is None:
        url = f"jdbc:{scheme}://{get('host', 'localhost')}:{get('port', '3306')}/{get('database', '')}"
    opts = {"url": url, "fetchsize": str(fetchsize)}
    if get("user"):
        opts["user"] = get("user")
    if get("password"):
        opts["password"] = get("password")
    if get("ssl_ca"):
        ca = get("ssl_ca")
        opts["sslMode"] = "VERIFY_CA"
        if url.startswith("jdbc:mariadb:"):  # that driver takes the certificate itself
            opts["serverSslCert"] = ca
        else:  # the MySQL driver takes a trust store
            opts.update({"trustCertificateKeyStoreUrl": ca if ":" in ca else f"file:{ca}",
                         "trustCertificateKeyStoreType": "PKCS12" if ca.endswith((".p12", ".pfx")) else "JKS"})
    return opts


def read_jdbc(spark: SparkSession, options: Mapping[str, str], table: str, *,
              bounds: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Read a table; ``bounds=(column, lower, upper, partitions)`` splits the scan into parallel ranges."""
    r = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if bounds:
        col, lo, hi, n = bounds
        r = (r.option("partitionColumn", col).option("lowerBound", str(lo))
             .option("upperBound", str(hi)).option("numPartitions", str(n)))
    return r.load()


def write_jdbc(df: DataFrame, options: Mapping[str, str], table: str, *, mode: str = "append",
               batchsize: int = 5_000) -> None:
    """Batched insert (``batchsize`` rows per round trip)."""
    df.write.format("jdbc").options(**options).option("dbtable", table).option(
        "batchsize", str(batchsize)).mode(mode).save()
