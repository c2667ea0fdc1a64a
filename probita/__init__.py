"""Customer-due-diligence and anti-money-laundering analytics as Spark DataFrame functions."""
