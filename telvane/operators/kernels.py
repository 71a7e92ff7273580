"""The functions of ``Kernels.java`` on binary columns: compiled by the driver, sent to the executors as a jar.

Spark's own compiler (Janino) is used, so nothing has to be installed. Where a session forbids it, ``kernel`` is None and
callers take their numpy code, which gives the same numbers.
"""

from __future__ import annotations

import hashlib
import logging
import os
import pkgutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NAMES = ("Grow", "Walk")
#: Names of the registered functions by session; empty where they could not be compiled.
_REGISTERED: dict[tuple, dict[str, str]] = {}


def kernel(spark: SparkSession, name: str) -> Callable[..., Column] | None:
    """A function of binary columns, or None where it cannot be compiled."""
    session = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID())
    if session not in _REGISTERED:
        try:
            _REGISTERED[session] = _register(spark)
        except Exception as e:  # py4j raises what the JVM raised
            logging.getLogger(__name__).warning("kernels not compiled, numpy is used: %s", e)
            _REGISTERED[session] = {}
    function = _REGISTERED[session].get(name)
    return (lambda *columns: F.call_function(function, *columns)) if function else None


def _register(spark: SparkSession) -> dict[str, str]:
    source = pkgutil.get_data(__package__, "Kernels.java").decode()
    package = f"telvane_{hashlib.md5(source.encode()).hexdigest()[:12]}"
    jvm, context = spark._jvm, spark.sparkContext
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source.replace("package telvane;", f"package {package};", 1))
    if not any(package in str(jar) for jar in context._jsc.sc().listJars().mkString(" ").split()):
        jar = os.path.join(tempfile.mkdtemp(prefix="telvane-"), f"{package}.jar")
        codes = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as out:
            for name in codes.keySet():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(codes.get(name)))
        context._jsc.addJar(jar)
    registered = {}
    for name in NAMES:
        function = compiler.getClassLoader().loadClass(f"{package}.{name}").getDeclaredConstructor(None).newInstance(None)
        spark._jsparkSession.udf().register(f"{package}_{name}", function, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
        registered[name] = f"{package}_{name}"
    return registered
