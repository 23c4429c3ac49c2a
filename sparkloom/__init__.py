"""sparkloom: code-intelligence and corpus analytics as Spark DataFrame programs."""
