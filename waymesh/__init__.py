"""waymesh: cooperative-perception analytics and corpus preparation on Spark DataFrames."""
