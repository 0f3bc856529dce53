"""Functions in Java beside this file, compiled by the Janino that Spark brings along for code of its own."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_added: dict[tuple[str, str], str | None] = {}


def name_of(source: str) -> str:
    """The function's name in SQL."""
    return f"loomstat_{source.lower()}"


def _jar(spark: SparkSession, source: str) -> str:
    """The path of a jar with the compiled classes, in the folder that Spark clears when it ends."""
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(pkgutil.get_data(__package__, f"{source}.java").decode())
    classes = compiler.getBytecodes()
    path = os.path.join(tempfile.mkdtemp(dir=spark.sparkContext._temp_dir), f"{name_of(source)}.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for name in classes:
            jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    return path


def registered(spark: SparkSession, source: str, kind: str) -> bool:
    """Whether the session has the function ``source`` of result ``kind``; it is registered if it can be."""
    try:
        at = (spark.sparkContext.applicationId, source)
        if at not in _added:
            _added[at] = None  # one try
            _added[at] = _jar(spark, source)
        if _added[at] is None:
            return False
        spark.sql(f"ADD JAR '{_added[at]}'")
        jvm = spark.sparkContext._jvm
        function = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(f"loomstat.{source}").newInstance()
        spark._jsparkSession.udf().register(name_of(source), function, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    except (AttributeError, OSError, TypeError, Py4JError, PySparkException):  # no JVM at hand, as with a remote session, no source or no such compiler
        return False
    return True
