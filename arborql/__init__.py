"""Graph-document analytics on Spark: traversals, filters, inheritance, aggregates, mutations and live queries."""
