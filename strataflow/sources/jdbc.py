"""Foreign tables: servers, user mappings and tables, read over JDBC with filters pushed down."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .scratch import scratch

#: Spark's names of types, the database's, and the setters of its statements.
KINDS = {"int": ("integer", "setInt"), "bigint": ("bigint", "setLong"), "double": ("double", "setDouble"), "string": ("clob", "setString")}


def shared_database(df: DataFrame, table: str) -> str:
    """The URL of a read-only database with df's rows: a Derby database belongs to one process, but one in an archive can be
    opened by many, so driver and executors read it from the shared folder, which they have to see as a local path. The rows
    pass the driver one partition at a time: for small tables."""
    from pyarrow import fs
    from py4j.protocol import Py4JJavaError

    spark = df.sparkSession
    place, folder = fs.FileSystem.from_uri(scratch(spark, "jdbc"))
    if not isinstance(place, fs.LocalFileSystem):
        raise ValueError("the database's archive can only be opened in a shared folder that is mounted as a local one")
    sql, work = spark.sparkContext._jvm.java.sql, tempfile.mkdtemp(prefix="strataflow-")
    try:
        con = sql.DriverManager.getConnection(f"jdbc:derby:{work}/db;create=true")
        con.setAutoCommit(False)
        columns = ", ".join(f'"{c}" {KINDS[kind][0]}' for c, kind in df.dtypes)
        con.createStatement().execute(f"create table {table} ({columns})")
        put = con.prepareStatement(f"insert into {table} values ({', '.join('?' * len(df.columns))})")
        for row in df.toLocalIterator():
            for i, (value, (_, kind)) in enumerate(zip(row, df.dtypes), 1):
                if value is None:
                    put.setNull(i, getattr(sql.Types, KINDS[kind][0].upper()))
                else:
                    getattr(put, KINDS[kind][1])(i, value)
            put.executeUpdate()
        con.commit()
        con.close()
        try:
            sql.DriverManager.getConnection(f"jdbc:derby:{work}/db;shutdown=true")
        except Py4JJavaError as e:  # how a shutdown that went well is told
            if e.java_exception.getSQLState() != "08006":
                raise
        os.makedirs(folder)
        with zipfile.ZipFile(f"{folder}/db.jar", "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(f"{work}/db"):
                for name in names:
                    z.write(f"{d}/{name}", os.path.relpath(f"{d}/{name}", work))
    finally:
        shutil.rmtree(work)
    return f"jdbc:derby:jar:({folder}/db.jar)db"


@dataclass
class Foreign:
    """CREATE SERVER, USER MAPPING and FOREIGN TABLE as a registry of options."""

    servers: dict[str, dict] = field(default_factory=dict)
    users: dict[tuple[str, str], dict] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)

    def create_server(self, name: str, url: str, **options: str) -> None:
        self.servers[name] = {"url": url, **options}

    def create_user_mapping(self, server: str, user: str, password: str, name: str = "") -> None:
        self.users[server, name] = {"user": user, "password": password}

    def create_table(self, name: str, server: str, table: str, schema: str | None = None) -> None:
        self.tables[name] = {"server": server, "dbtable": f"{schema}.{table}" if schema else table}

    def alter_server(self, name: str, **options: str) -> None:
        """ALTER SERVER: options are set, or taken away if None."""
        known = self.servers[name] | options
        self.servers[name] = {k: v for k, v in known.items() if v is not None}

    def drop_user_mapping(self, server: str, name: str = "") -> None:
        del self.users[server, name]

    def drop_table(self, name: str) -> None:
        del self.tables[name]

    def drop_server(self, name: str) -> None:
        del self.servers[name]
        self.tables = {k: v for k, v in self.tables.items() if v["server"] != name}

    def options(self, name: str, user: str = "") -> dict[str, str]:
        t = self.tables[name]
        return self.servers[t["server"]] | {"dbtable": t["dbtable"]} | self.users.get((t["server"], user), {})

    def read(self, spark: SparkSession, name: str, user: str = "", column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        """The table; with a column and its bounds it is read in parts."""
        o = self.options(name, user)
        if column:
            o |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
        return spark.read.format("jdbc").options(**o).load()
