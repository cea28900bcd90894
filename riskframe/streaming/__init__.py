from riskframe.streaming import logs

__all__ = ["logs"]
