"""Analytics over keyed mutation logs on Spark."""
