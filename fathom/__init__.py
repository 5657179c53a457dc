"""fathom: column profiling, cleaning and query helpers expressed as Spark DataFrame plans.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with ``df.transform``)
that Catalyst can optimise; nothing here pulls a whole table through the driver.
"""

from fathom.session import get_spark, checkpoint_dir, reliable_checkpoint, scratch_path

__all__ = ["get_spark", "checkpoint_dir", "reliable_checkpoint", "scratch_path"]
