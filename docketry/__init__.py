"""docketry: case-record analytics expressed as Spark DataFrame transformations."""
