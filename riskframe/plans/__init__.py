from riskframe.plans import etl, explore, training

__all__ = ["etl", "explore", "training"]
