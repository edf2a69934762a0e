"""massloom.streaming"""
