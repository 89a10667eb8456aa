"""The operational database: reads in ranges of equal counts, writes as an upsert from a staging table."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Buckets of one histogram query, and how many times less than a range a bucket holds before it is not parted further.
BUCKETS, FINENESS = 1000, 4


class Database:
    """Tables behind a JDBC URL. options are the source's own: user, password, driver, queryTimeout."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    @contextmanager
    def connection(self) -> Iterator:
        """A connection of the driver's, for statements; rolled back unless the block ends well."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, str(v))
        opened = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            opened.setAutoCommit(False)
            yield opened
            opened.commit()
        except BaseException:
            opened.rollback()
            raise
        finally:
            opened.close()

    def alive(self, seconds: int = 5) -> bool:
        """Whether a new connection answers."""
        try:
            with self.connection() as c:
                return c.isValid(seconds)
        except Exception:
            return False

    def execute(self, *statements: str) -> list[int]:
        """Statements in one transaction; the rows that each changed."""
        with self.connection() as c:
            changed = []
            for s in statements:
                one = c.createStatement()
                changed.append(one.executeUpdate(s))
                one.close()
            return changed

    def query(self, sql: str) -> DataFrame:
        """A query that the database works out."""
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({sql}) q", fetchsize="10000", **self.options).load()

    def _histogram(self, table: str, column: str, low: int, high: int, most: int) -> list[tuple[int, int, int]]:
        """(from, to, rows) of ranges of the column that hold rows, none of more than `most` unless a single value does.

        One grouped query for each level: BUCKETS equal widths, and those that hold too many once more.
        """
        width = max(1, -(-(high - low + 1) // BUCKETS))
        inner = f"SELECT ({column} - ({low})) / {width} AS bucket FROM {table} WHERE {column} >= {low} AND {column} <= {high}"
        rows = self.query(f"SELECT bucket, COUNT(*) AS n FROM ({inner}) b GROUP BY bucket").collect()  # BUCKETS rows at most
        found = []
        for bucket, n in sorted((int(r[0]), int(r[1])) for r in rows):
            a, b = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
            found += self._histogram(table, column, a, b, most) if n > most and a < b else [(a, b, n)]
        return found

    def ranges(self, table: str, column: str, parts: int) -> list[str]:
        """Predicates that part a table's rows into at most `parts` ranges of an integer column, of about equal counts however its values lie."""
        low, high, n = self.query(f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n FROM {table}").first()
        if low is None:
            return ["1 = 1"]
        share = -(-int(n) // parts)
        starts, held = [], 0
        for a, _, rows in self._histogram(table, column, int(low), int(high), max(1, share // FINENESS)):
            if not starts or held >= share or (held + rows > share and share - held < held + rows - share):
                starts.append(a)
                held = 0
            held += rows
        bounds = list(zip(starts, [*starts[1:], None], strict=True))
        test = lambda a, b: " AND ".join([f"{column} >= {a}"] * (a != starts[0]) + [f"{column} < {b}"] * (b is not None)) or "1 = 1"
        first, *rest = [test(a, b) for a, b in bounds]
        return [first if first == "1 = 1" else f"{first} OR {column} IS NULL", *rest]

    def read(self, table: str, column: str = "id", parts: int = 30) -> DataFrame:
        """A table, read in `parts` ranges of a key, so many at a time; filters and columns go to the database. Names are in lower case, as the library's are."""
        found = self.spark.read.jdbc(self.url, table, predicates=self.ranges(table, column, parts), properties={"fetchsize": "10000", **self.options})
        return found.toDF(*[c.lower() for c in found.columns])

    def upsert(self, df: DataFrame, table: str, key: str = "id", connections: int = 10) -> int:
        """Insert rows and replace those of equal keys; how many the table changed by.

        Tasks write to a staging table, at most `connections` at a time. One statement then merges it, which leaves
        rows alone that are what they should be: a run after a failure, or a second one, does no harm, and the second returns 0.
        """
        stage, columns, options, kinds = f"{table}_stage", df.columns, {k: str(v) for k, v in self.options.items()}, self.kinds(table)
        # By the names that the database itself gives the columns, which Spark quotes.
        df.toDF(*[kinds[c.lower()][0] for c in columns]).coalesce(connections).write.jdbc(self.url, stage, mode="overwrite", properties=options)
        # Cast, as Spark's choice of a type for the staging table may not compare with the table's own.
        value = {c: f"CAST(s.{c} AS {kinds[c.lower()][1]})" for c in columns}
        others = [c for c in columns if c != key]
        differs = " OR ".join(f"t.{c} <> {value[c]} OR (t.{c} IS NULL AND s.{c} IS NOT NULL) OR (t.{c} IS NOT NULL AND s.{c} IS NULL)" for c in others)
        update = f"WHEN MATCHED AND ({differs}) THEN UPDATE SET {', '.join(f'{c} = {value[c]}' for c in others)} " if others else ""
        merge = f"MERGE INTO {table} t USING {stage} s ON t.{key} = s.{key} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(value.values())})"
        return self.execute(merge, f"DROP TABLE {stage}")[0]

    def kinds(self, table: str) -> dict[str, tuple[str, str]]:
        """The name and SQL type of each column, by its name in lower case, as the database tells."""
        found = {}
        with self.connection() as c:
            empty = c.createStatement().executeQuery(f"SELECT * FROM {table} WHERE 1 = 0")
            told = empty.getMetaData()
            for i in range(1, told.getColumnCount() + 1):
                name, size = told.getColumnTypeName(i), told.getPrecision(i)
                of = f"({size})" if "CHAR" in name.upper() else f"({size}, {told.getScale(i)})" if name.upper() in ("DECIMAL", "NUMERIC") else ""
                found[told.getColumnName(i).lower()] = (told.getColumnName(i), name + of)
            empty.close()
        return found

    def create(self, table: str, columns: str) -> None:
        """A table by the columns of sources.tables, unless it is there; id is its key."""
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR(2000)", "timestamp_ntz": "TIMESTAMP"}
        parts = []
        for c in columns.split(","):
            name, kind = c.strip().split(" ")
            parts.append(f"{name} {kinds[kind.rstrip('?')]}{'' if kind.endswith('?') else ' NOT NULL'}")
        try:
            self.execute(f"CREATE TABLE {table} ({', '.join(parts)}, PRIMARY KEY (id))")
        except Exception as e:
            if "already exists" not in str(e).lower():
                raise

    def drop(self, table: str) -> None:
        self.execute(f"DROP TABLE {table}")
