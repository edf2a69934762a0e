"""massloom.sources"""
