"""greenscan: watermark detection and evaluation for text tables on Spark.

The public surface is a set of Column builders (``greenscan.functions``) and
DataFrame operators (``greenscan.operators``) driven by one frozen
:class:`~greenscan.config.WatermarkConfig`.
"""

from greenscan.config import WatermarkConfig

__all__ = ["WatermarkConfig"]
