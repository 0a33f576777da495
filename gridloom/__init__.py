"""gridloom: gridded-imagery and evaluation analytics as Spark DataFrames."""
