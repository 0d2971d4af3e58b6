"""Programs of small query languages, compiled to plans over tables of things, links and numbers."""
