"""Sources and sinks. Every source ends in the same record envelope."""
