"""tillroll — retail analytics (RFM segmentation, product clustering, market-basket
rules and the queries served over them) expressed as Spark DataFrame / SQL jobs."""

__version__ = "0.1.0"
